import zlib

import pytest
from pyspark.sql import functions as F

from marketlens.llm import merkle
from tests.llm.tools import corpus, sha

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf int, row_no int"


def leaf(row):
    parts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row]
    return sha("".join(parts))


def climb(nodes, at, start):
    """The root over `nodes`, the siblings of the one `at`, and the fold of `start`."""
    siblings = []
    while len(nodes) > 1:
        first = at - at % 3
        run = nodes[first : first + 3]
        siblings += run[: at - first] + run[at - first + 1 :]
        start = sha("".join(run[: at - first] + [start] + run[at - first + 1 :]))
        nodes = [sha("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)]
        at //= 3
    return nodes[0], siblings, start


def by_hand(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for source in order:
        groups[source].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    roots = [climb([leaf(r) for r in groups[s]], 0, "")[0] for s in order]
    out = []
    for k, source in enumerate(order):
        leaves = [leaf(r) for r in groups[source]]
        for at, row in enumerate(groups[source]):
            text = row[4]
            if text is not None and row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            subroot, low, folded = climb(leaves, at, leaf((*row[:4], text)))
            root, high, folded = climb(roots, k, folded)
            out.append((row[0], leaves[at], subroot, root, sha("".join(low + high)), folded, folded == root))
    return out


def found(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA).repartition(3)
    return [tuple(r) for r in merkle.manifest(df, merkle.without_line_breaks).collect()]


def in_order(rows):
    return sorted(rows, key=str)


def documents(n, sources):
    texts = corpus(n)
    return [
        (i, sources[i * i % len(sources)], None if i % 7 == 0 else "de", len(text or ""), text)
        for i, text in texts
    ]


@pytest.mark.parametrize("n", [0, 1, 2, 4, 81])
def test_one_source(spark, n):
    rows = [(i, "s", "en", 3, f"a\nb{i}") for i in range(n)]
    assert in_order(found(spark, rows)) == in_order(by_hand(rows))


def test_many_sources_nulls_and_repeated_rows(spark):
    rows = documents(150, [None, "", "ä", "z", "big", "big", "big"])
    rows += [(None, "z", None, None, None), (None, "z", None, None, "x\ny"), (9, "z", "en", 1, "other\n")]
    rows += rows[:5] * 3
    result = found(spark, rows)
    assert in_order(result) == in_order(by_hand(rows))
    assert {r[-1] for r in result} == {True, False}


def test_one_large_source_of_several_steps(spark):
    rows = [(i, "big" if i % 40 else f"s{i}", "en", i, "line\nline") for i in range(1200)]
    rows.append((5000, "big", "en", None, "long \n" * 400_000))
    assert in_order(found(spark, rows)) == in_order(by_hand(rows))


def test_the_tampered_text_is_a_parameter(spark):
    rows = documents(20, ["a", "b"])
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)
    same = merkle.manifest(df, lambda doc_id, text: text)
    assert same.filter("verified").count() == len(rows)
    other = merkle.manifest(df, lambda doc_id, text: F.concat(F.coalesce(text, F.lit("")), F.lit("!")))
    assert other.filter("verified").isEmpty()
