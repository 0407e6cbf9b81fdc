import random

from marketlens.llm import warc
from marketlens.llm.warc import archive_round_trip, coalesced, parse_record, read_records, record_bytes, write_archives
from marketlens.session import new_table_path

from tests.llm.tools import frame, sha, words

PAGES = "page_id long, url string, html string, file string"


def pages(n=200, seed=2):
    rng = random.Random(seed)
    bodies = [words(rng, rng.randrange(2, 90)) + "\r\n\r\n" for _ in range(n // 3)] + ["", None, "kurz"]
    return [(i, f"http://x.example/{i}", rng.choice(bodies), "own column") for i in range(n)]


def brute(rows):
    first = {}
    for page_id, _, html, _ in rows:
        if len((html or "").encode()) >= 100:
            first[html] = min(first.get(html, page_id), page_id)
    out = set()
    for page_id, _, html, _ in rows:
        other = first.get(html, page_id)
        refers = other if other != page_id else None
        data = (html or "").encode()
        out.add((page_id, len(data), sha(data), "revisit" if refers is not None else "response", refers))
    return out


def test_round_trip_equals_brute_force(spark):
    rows = pages()
    found = archive_round_trip(frame(spark, rows, PAGES))
    assert {tuple(r)[:5] for r in found.collect()} == brute(rows) and found.count() == len(rows)


def test_payloads_come_back_from_selected_ranges(spark):
    rows = pages()
    folder = new_table_path(spark, "warc-test")
    index = write_archives(frame(spark, rows, PAGES), folder)
    assert index.select("file", "offset").distinct().count() == len(rows)
    wanted = index.filter("page_id % 7 = 0 AND record_type = 'response'")
    got = {r.page_id: r.payload.decode() for r in read_records(wanted, folder, with_payload=True).collect()}
    assert got == {i: html or "" for i, _, html, _ in rows if i in got}
    assert len(got) == wanted.count()


def test_odd_rows(spark):
    long = "x" * 200
    rows = [(1, None, long, "f"), (1, "a\r\nb: c", long, "f"), (None, "u", long, "f"), (0, "u", "y", "f"), (5, "u", long, "f")]
    found = archive_round_trip(frame(spark, rows, PAGES)).collect()
    assert sorted((r.page_id or -1, r.record_type, r.refers_to) for r in found) == sorted([
        (1, "response", None), (1, "response", None), (-1, "response", None), (-1, "response", None), (5, "revisit", 1)])
    assert {r.payload_bytes for r in found} == {200, 1}
    assert archive_round_trip(frame(spark, [], PAGES)).collect() == []


def test_ranges_are_coalesced():
    assert coalesced([(0, 10), (12, 5), (100, 5)], gap=4) == [[0, 17, [(0, 10), (12, 5)]], [100, 105, [(100, 5)]]]
    assert len(coalesced([(0, 10), (10, 10)], most=15)) == 2


def test_record_format():
    raw = record_bytes(3, "http://e.example/", b"body", "aa", None)
    headers, payload = parse_record(raw)
    assert payload == b"body" and headers["warc-type"] == "response"
    headers, payload = parse_record(record_bytes(3, "u", b"body", "aa", 1))
    assert payload is None and headers["warc-refers-to"].endswith("page:1>")
    assert warc.LEAST_REVISIT_BYTES == 100
