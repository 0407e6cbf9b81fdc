"""Document fingerprints of closed syncmers, in DataFrame functions only.

A k-mer is CHARS characters in a row; it is chosen if the smallest hash of its parts, the PART
characters from each of its places on, is that of its first or its last part. That depends on the
k-mer alone and not on what surrounds it, so a passage gives the same anchors in any text. Past
its end a text goes on with parts that are larger than all others, so that short texts have
anchors too. The hash of a k-mer is that of the parts PART apart, which hold all its characters.

`with_fingerprint` does the same for tokens, stretches without white space that are cut after 16
characters, with k-mers of K tokens.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

K = 4
TOKEN = r"\S{1,16}"
CHARS = 12
PART = 4
#: Parts of a k-mer of characters.
PARTS = CHARS - PART + 1
#: Digits of an anchor in `as_text`.
DIGITS = 8
#: Bytes of text in a range of documents, about.
RANGE_BYTES = 16 << 20
_AFTER_END = 2**63 - 1


def token_hashes(text, k=K):
    """A hash per token, in text order, then k - 1 for the end; null and empty texts: no tokens."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))
    hashes = F.transform(found, lambda token: F.xxhash64(token))
    return F.concat(hashes, F.array_repeat(F.lit(_AFTER_END).cast("long"), k - 1))


def part_hashes(text):
    """A hash per character, of the PART from there on or fewer at the end, then PARTS - 1 for the end."""
    # The look-ahead holds the part; what is matched is one character.
    found = F.regexp_extract_all(
        F.coalesce(text, F.lit("")), F.lit(rf"(?s)(?=(.{{1,{PART}}}))."), F.lit(1)
    )
    hashes = F.transform(found, lambda part: F.xxhash64(part))
    return F.concat(hashes, F.array_repeat(F.lit(_AFTER_END).cast("long"), PARTS - 1))


def syncmers(padded, k=K, step=1):
    """From `token_hashes`, the anchors: structs of the place of the k-mer, from 1, and its hash.

    `padded` has to be a column that is there: an expression would be computed for every token.
    The hash is that of every `step`-th token of the k-mer.
    """
    n_tokens = F.size(padded) - (k - 1)

    def kmer(i):
        # Item by item: cutting out a slice would copy the whole array each time.
        return [F.get(padded, i + (j - 1)) for j in range(k)]

    def closed(i):
        tokens = kmer(i)
        inner = F.least(*tokens[1:-1]) if k > 3 else tokens[1]
        return F.least(tokens[0], tokens[-1]) <= inner

    places = F.when(n_tokens > 0, F.sequence(F.lit(1), n_tokens)).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(
        F.filter(places, closed),
        lambda i: F.struct(i.alias("place"), F.xxhash64(*kmer(i)[::step]).alias("hash")),
    )


def with_fingerprint(df, text_col, to):
    """Add `to`, the array of a text's anchors. A helper column gets a name that `df` doesn't have."""
    return _with_anchors(df, token_hashes(F.col(text_col)), K, to)


def with_char_fingerprint(df, text_col, to):
    """As `with_fingerprint`, of characters; places are those of characters, from 1."""
    return _with_anchors(df, part_hashes(F.col(text_col)), PARTS, to, PART)


def _with_anchors(df, padded, k, to, step=1):
    hashes = f"{to}_hashes"
    while hashes in df.columns:
        hashes += "_"
    return df.withColumn(hashes, padded).withColumn(to, syncmers(F.col(hashes), k, step)).drop(hashes)


def long_fingerprints(df, within):
    """Anchors as `with_char_fingerprint` finds them in `text`, as `anchors`, for texts of any length.

    A row per character, from which the k-mers are looked at, is what Spark compiles; functions of
    array items are interpreted one by one. Nothing is shuffled if `df` is dealt by the column `within`.
    """
    own = [c for c in df.columns if c != within]
    numbered = df.withColumn("_row", F.monotonically_increasing_id())
    padded = numbered.withColumn("_padded", part_hashes(F.col("text")))
    # Never an empty array; without the outer form Spark would look for those, and hash twice.
    parts = padded.select("*", F.posexplode_outer("_padded").alias("_at", "_first"))
    at = F.col("_at")
    kmer = [F.col("_first"), *[F.get("_padded", at + j) for j in range(1, PARTS)]]
    closed = (at < F.size("_padded") - (PARTS - 1)) & (
        F.least(kmer[0], kmer[-1]) <= F.least(*kmer[1:-1])
    )
    anchor = F.struct((at + 1).alias("place"), F.xxhash64(*kmer[::PART]).alias("hash"))
    found = parts.filter(closed | (at == 0)).select(
        within,
        "_row",
        F.when(at == 0, F.struct(*own)).alias("_own"),
        F.when(closed, anchor).alias("_anchor"),
    )
    # The rows of a text may come in any order from the aggregate.
    together = found.groupBy(within, "_row").agg(
        F.first("_own", ignorenulls=True).alias("_own"),
        F.sort_array(F.collect_list("_anchor")).alias("anchors"),
    )
    return together.select(within, "_own.*", "anchors")


def likeness(a, b):
    """Shared hashes among all hashes of two anchor arrays, 0 to 1; 1 for two empty arrays."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(F.array_union(a, b))
    # Named once: in a condition and a branch the union would be made twice.
    return F.coalesce(F.try_divide(both, either), F.lit(1.0))


def as_text(hashes):
    """Anchors in text order as 8 hexadecimal digits each."""
    digits = F.transform(hashes, lambda h: F.lpad(F.hex(F.shiftrightunsigned(h, 32)), DIGITS, "0"))
    return F.lower(F.array_join(digits, ""))


def _up_to(places, last):
    """How many of the sorted places are at most `last`."""
    return F.size(F.filter(places, lambda place: place <= last))


def _range_of(doc_id, points):
    """The number of the range between sorted `points` that an id is in; ids that are null last."""
    known = F.size(F.filter(F.array(*[F.lit(p) for p in points]), lambda p: p < doc_id))
    return F.when(doc_id.isNull(), F.lit(len(points) + 1)).otherwise(known if points else F.lit(0))


def edit_fingerprints(docs, id_col="doc_id", text_col="text"):
    """Per row: fingerprints of its text and of an edited one, and how alike they are.

    The edited text has the last quarter of the characters, rounded down, replaced by the first as
    many (or all) of the next document by id; the last document is followed by the first. Null
    texts are empty. Rows without id come last; rows with the same id are ordered by a hash of
    the text, and a repeated row follows itself. Other columns are ignored.

    Documents are dealt to ranges of ids, whose bounds are approximate quantiles, and follow each
    other within a range; what follows the last of a range is the first of a later one. The number
    of ranges grows with the texts, so that a task sorts as much of a large table as of a small one.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_ranges = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), n_bytes // RANGE_BYTES)
    shares = F.array(*[F.lit(i / n_ranges) for i in range(1, n_ranges)])
    points = rows.agg(F.percentile_approx("doc_id", shares, 100 * n_ranges)).first()[0]
    points = sorted(set(points or []))
    named = rows.select("doc_id", "text", F.xxhash64("text").alias("h")).withColumn(
        "range", _range_of(F.col("doc_id"), points)
    )
    # The first document of each range: at most n_ranges + 1 rows.
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")
    firsts = named.groupBy("range").agg(F.min(order).alias("first"))
    firsts = firsts.select(
        F.col("range").alias("begun"), F.col("first.doc_id").alias("id"), F.col("first.h").alias("hash")
    )
    texts = (
        rows.withColumn("h", F.xxhash64("text"))
        .join(F.broadcast(firsts), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("hash")))
        .groupBy(F.col("begun").alias("range"))
        .agg(F.first("text").alias("text"))
    )
    around = Window.orderBy("range")
    everywhere = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follower = F.coalesce(F.lead("text").over(around), F.first("text").over(everywhere))
    after_range = texts.select("range", follower.alias("after"))
    after_range = (
        with_char_fingerprint(after_range, "after", "after_anchors")
        .select(
            "range",
            "after",
            F.col("after_anchors.place").alias("after_places"),
            F.col("after_anchors.hash").alias("after_hashes"),
        )
        .withColumn("after_fingerprint", as_text(F.col("after_hashes")))
    )
    n_chars = F.char_length("text").cast("long")
    whole = (
        long_fingerprints(named.repartition(n_ranges, "range"), "range")
        .withColumn("n_chars", n_chars)
        .withColumn("n_left", F.expr("n_chars - n_chars div 4"))
        .select("doc_id", "h", "range", "text", "n_chars", "n_left",
                F.col("anchors.place").alias("places"), F.col("anchors.hash").alias("hashes"))
        .withColumn("fingerprint", as_text(F.col("hashes")))
    )
    within = Window.partitionBy("range").orderBy(F.col("doc_id").asc_nulls_last(), "h")
    of_next = {"text": "after", "places": "after_places", "hashes": "after_hashes", "fingerprint": "after_fingerprint"}
    followed = whole
    for name in of_next:
        followed = followed.withColumn(f"next_{name}", F.lead(name).over(within))
    followed = followed.join(after_range, "range", "left")
    for name, after in of_next.items():
        followed = followed.withColumn(f"next_{name}", F.coalesce(f"next_{name}", after))
    # Anchors that lie in what the edit leaves, or in what it puts in, are those of the edited text
    # as well. Others begin up to CHARS - 1 characters before what is put in, or before the end; if
    # little is put in, both are one piece.
    reach = CHARS - 1
    edited = (
        followed.withColumn("put_in", F.expr("substring(next_text, 1, cast(n_chars div 4 as int))"))
        .withColumn("n_in", F.char_length("put_in"))
        .withColumn("left", F.expr("substring(text, 1, cast(n_left as int))"))
        .withColumn("before_seam", F.expr(f"right(left, {reach})"))
        .withColumn("is_long", F.col("n_in") >= reach)
        .select(
            "doc_id",
            "n_chars",
            "hashes",
            "fingerprint",
            "next_hashes",
            "next_fingerprint",
            _up_to("places", F.col("n_left") - reach).alias("n_same"),
            _up_to("next_places", F.col("n_in") - reach).alias("n_next"),
            F.sha2(F.concat("left", "put_in").cast("binary"), 256).alias("edited_sha256"),
            F.concat("before_seam", F.substring("put_in", 1, reach)).alias("seam"),
            F.when(F.col("is_long"), F.char_length("before_seam")).alias("n_seam"),
            F.when(F.col("is_long"), F.expr(f"right(put_in, {reach})")).otherwise("").alias("end"),
        )
    )
    both = with_char_fingerprint(edited, "seam", "seam_anchors")
    both = with_char_fingerprint(both, "end", "end_anchors")
    of_seam = F.filter(
        "seam_anchors", lambda a: F.col("n_seam").isNull() | (a["place"] <= F.col("n_seam"))
    )
    both = (
        both.withColumn("seam_hashes", of_seam["hash"])
        .withColumn("end_hashes", F.col("end_anchors.hash"))
        .withColumn(
            "edited_hashes",
            F.concat(
                F.slice("hashes", F.lit(1), F.col("n_same")),
                F.col("seam_hashes"),
                F.slice("next_hashes", F.lit(1), F.col("n_next")),
                F.col("end_hashes"),
            ),
        )
        .withColumn(
            "edited_fingerprint",
            F.concat(
                F.expr(f"substring(fingerprint, 1, {DIGITS} * n_same)"),
                as_text(F.col("seam_hashes")),
                F.expr(f"substring(next_fingerprint, 1, {DIGITS} * n_next)"),
                as_text(F.col("end_hashes")),
            ),
        )
    )
    return both.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"),
        likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"),
    )
