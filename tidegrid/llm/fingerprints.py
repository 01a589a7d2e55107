"""Merkle fingerprints of documents: root, sections, paragraphs, and pieces within paragraphs; DataFrame functions only.

Paragraphs are lines.  A section ends after each paragraph whose digest begins with a byte divisible by SECTION, so where
sections end depends on the text alone, and an inserted or deleted line changes its own section and at most the next
one.  A paragraph's digest is the SHA-256 of its text, a section's that of its paragraphs' digests, the root's that of
the sections' digests: equal roots mean equal texts.  Where roots differ, ``differing`` descends: sections of one tree
that the other lacks, and within these the paragraphs that it lacks, with their places.  Below, a paragraph is cut into
pieces with 64-bit digests, so that likeness sees a change within a long paragraph.  A piece ends after a word whose last
letter says so, after PIECE words at most, and at the paragraph's end: words put in or left out change the pieces around
them, and the pieces after the next such word are the same again.

Likeness of two trees is twice the number of pieces that both have (as often as both have them) over all pieces of
both: 1 for equal texts, 0 for texts without a common piece; two empty texts have 1.

Defined results: a null text is empty; rows of one doc_id are ordered by text, null ids come first; the next of the last
row is the first one; texts of any length are taken whole; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions

PIECE = 16
SECTION = 8
#: Last letters of words that end a piece: ends of sentences, and the letter m of several alphabets.
_ENDS = r".!?mM\x{3BC}\x{43C}\x{574}\x{5DD}\x{645}\x{92E}"
_PIECES = rf"(?:[^ \t\n\x0B\f\r]++(?<![{_ENDS}])[ \t\x0B\f\r]++){{0,%d}}[^ \t\n\x0B\f\r]++[ \t\x0B\f\r]*+\n*+|[ \t\n\x0B\f\r]++"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once for a row: named within another lambda, it would be computed for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def pieces(text: Column, words: int = PIECE) -> Column:
    """64-bit digests of the pieces of a text; the pieces' texts joined are the text."""
    return F.transform(F.regexp_extract_all(text, F.lit(_PIECES % (words - 1)), F.lit(0)), lambda x: F.xxhash64(x))


def paragraphs(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda x: F.sha2(x, 256))


def sections(paragraph_digests: Column) -> Column:
    """The sections of a text as arrays of its paragraphs' digests."""

    def cut(p: Column) -> Column:
        last = lambda i: (i == F.size(p)) | (F.conv(F.substring(F.element_at(p, i), 1, 2), 16, 10).cast("int") % SECTION == 0)
        before = lambda ends: F.concat(F.array(F.lit(0)), F.slice(ends, 1, F.size(ends) - 1))
        return _once(F.filter(F.sequence(F.lit(1), F.size(p)), last), lambda ends: F.zip_with(before(ends), ends, lambda a, z: F.slice(p, a + 1, z - a)))

    return _once(paragraph_digests, cut)


def section_digests(sections_: Column) -> Column:
    return F.transform(sections_, lambda s: F.sha2(F.array_join(s, ""), 256))


def root(digests_of_sections: Column) -> Column:
    return F.sha2(F.array_join(digests_of_sections, ""), 256)


def with_tree(docs: DataFrame, text: str, prefix: str = "") -> DataFrame:
    """Adds <prefix>sections (arrays of paragraph digests), <prefix>section_digests and <prefix>fingerprint of a text."""
    docs = docs.withColumn(f"{prefix}sections", sections(paragraphs(F.col(text))))
    docs = docs.withColumn(f"{prefix}section_digests", section_digests(F.col(f"{prefix}sections")))
    return docs.withColumn(f"{prefix}fingerprint", root(F.col(f"{prefix}section_digests")))


def differing(sections_: Column, digests: Column, other_sections: Column, other_digests: Column) -> Column:
    """The branches of a tree that another lacks, as (section, paragraph), from 0: of each differing section those
    paragraphs that no differing section of the other has.  Equal sections are not looked into."""
    changed = F.filter(F.zip_with(F.sequence(F.lit(0), F.size(digests) - 1), F.arrays_zip(sections_.alias("s"), digests.alias("d")), lambda i, x: F.struct(i.alias("i"), x["s"].alias("s"), x["d"].alias("d"))), lambda x: ~F.array_contains(other_digests, x["d"]))
    theirs = F.flatten(F.transform(F.filter(F.arrays_zip(other_sections.alias("s"), other_digests.alias("d")), lambda x: ~F.array_contains(digests, x["d"])), lambda x: x["s"]))
    branch = lambda x, known: F.filter(F.transform(x["s"], lambda p, k: F.when(~F.array_contains(known, p), F.struct(x["i"].alias("section"), k.cast("int").alias("paragraph")))), lambda y: y.isNotNull())
    return _once(theirs, lambda known: F.flatten(F.transform(changed, lambda x: branch(x, known))))


def likeness(one: Column, two: Column) -> Column:
    """Likeness of two trees from their pieces' digests: the sides are told apart by the last bit, sorted, and counted."""
    side = lambda x, bit: F.transform(x, lambda v: v.bitwiseAND(F.lit(-2)).bitwiseOR(F.lit(bit)))
    both = F.array_sort(F.concat(side(one, 0), side(two, 1)))
    zero = F.struct(F.lit(None).cast("long").alias("key"), F.lit(0).alias("left"), F.lit(0).alias("common"))

    def step(state: Column, v: Column) -> Column:
        key, mine = v.bitwiseAND(F.lit(-2)), v.bitwiseAND(F.lit(1)) == 0
        left = F.when(state["key"].eqNullSafe(key), state["left"]).otherwise(0)
        hit = ~mine & (left > 0)
        return F.struct(key.alias("key"), F.when(mine, left + 1).when(hit, left - 1).otherwise(left).alias("left"), (state["common"] + hit.cast("int")).alias("common"))

    common = F.aggregate(both, zero, step, lambda s: s["common"])
    total = F.size(one) + F.size(two)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * common / F.greatest(total, F.lit(1)))


def with_next(docs: DataFrame, *columns: str) -> DataFrame:
    """Adds next_<column> of the row that follows in the order of doc_id, the first one's for the last.

    Rows are dealt into parts by quantiles of doc_id, each of which also receives the first row of the part after it;
    the quantiles and the parts' first ids are all that the driver sees, four numbers for each shuffle partition.
    """
    parts = 4 * partitions(docs.sparkSession)
    shares = [k / parts for k in range(1, parts)]
    cuts = docs.agg(F.percentile_approx("doc_id", shares, max(10_000, 10 * parts))).first()[0] or []
    cuts = sorted(set(cuts))
    own = F.coalesce(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("doc_id"))), F.lit(0)) if cuts else F.lit(0)
    own = F.when(F.col("doc_id").isNull(), 0).otherwise(own)
    starts = docs.select("doc_id", own.alias("part")).groupBy("part").agg(F.min("doc_id").alias("least"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).collect()
    starts = sorted((r["part"], None if r["nulls"] else r["least"]) for r in starts)
    guests = [(first, starts[k - 1][0]) for k, (_, first) in enumerate(starts)]
    guests = docs.sparkSession.createDataFrame(guests, docs.select(F.col("doc_id").alias("first"), F.lit(0).alias("guest_part")).schema)
    joined = docs.join(F.broadcast(guests), docs["doc_id"].eqNullSafe(guests["first"]), "left").withColumn("own_part", own)
    stays = F.array(F.struct(F.col("own_part").alias("part"), F.lit(False).alias("guest")), F.struct(F.col("guest_part").alias("part"), F.lit(True).alias("guest")))
    dealt = joined.withColumn("stay", F.explode(F.filter(stays, lambda s: s["part"].isNotNull())))
    order = Window.partitionBy("stay.part").orderBy("stay.guest", F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))
    following = [F.lead(c).over(order).alias(f"next_{c}") for c in columns]
    return dealt.select(*docs.columns, "stay", *following).where(~F.col("stay.guest")).drop("stay")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text, pieces, sections, section_digests and fingerprint of each document."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return with_tree(texts.withColumn("pieces", pieces(F.col("text"))), "text")


def op3_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = with_next(texts.withColumn("pieces", pieces(F.col("text"))), "text", "pieces")
    docs = with_tree(docs, "text")  # after the shuffle, which moves the text and its pieces only
    n = F.char_length("text")
    docs = docs.withColumn("n_chars", n.cast("long")).withColumn("swapped", F.floor(n / 4).cast("int"))
    docs = docs.withColumn("edited", F.expr("concat(substring(text, 1, char_length(text) - swapped), substring(next_text, 1, swapped))"))
    docs = docs.drop("text", "next_text").withColumn("edited_pieces", pieces(F.col("edited")))
    docs = with_tree(docs, "edited", "edited_")
    docs = docs.withColumn("changed", differing(F.col("edited_sections"), F.col("edited_section_digests"), F.col("sections"), F.col("section_digests")))
    return docs.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("pieces"), F.col("edited_pieces")).alias("near_edited"), likeness(F.col("pieces"), F.col("next_pieces")).alias("near_next"),
        F.size("changed").cast("long").alias("n_changed"), F.get("changed", F.lit(0))["section"].cast("long").alias("changed_section"), F.get("changed", F.lit(0))["paragraph"].cast("long").alias("changed_paragraph"),
    )


_SQL_PIECES = rf"(?:(?:[{_ENDS}]*[^ \t\n\x0B\f\r{_ENDS}])+[ \t\x0B\f\r]+){{0,15}}[^ \t\n\x0B\f\r]+[ \t\x0B\f\r]*\n*|[ \t\n\x0B\f\r]+"
_SQL_SECTIONS = "list_transform(list_zip(list_concat([0], {e}[:-2]), {e}), lambda x: {p}[x[1] + 1:x[2]])"
_SQL_ENDS = "list_filter(range(1, len({p}) + 1), lambda i: i = len({p}) OR ('0x' || left({p}[i], 2))::INT % 8 = 0)"
_SQL_DIGESTS = "list_transform({s}, lambda x: sha256(array_to_string(x, '')))"
_SQL_LIKE = """
    SELECT x.doc_id, CASE WHEN any_value(x.n + y.n) = 0 THEN 1.0e0 ELSE 2.0e0 * sum(CASE WHEN y2.times IS NULL THEN 0 ELSE least(x.times, y2.times) END) / greatest(any_value(x.n + y.n), 1) END AS likeness
    FROM (SELECT doc_id, n, leaf, times FROM own) x
    JOIN (SELECT doc_id, any_value(n) AS n FROM {other} GROUP BY doc_id) y ON x.doc_id = y.doc_id
    LEFT JOIN {other} y2 ON y2.doc_id = x.doc_id AND y2.leaf = x.leaf
    GROUP BY x.doc_id"""


def _sql_leaves(column: str, source: str = "changed") -> str:
    inner = f"SELECT doc_id, regexp_extract_all({column}, '{_SQL_PIECES}') AS leaves FROM {source}"
    return f"SELECT doc_id, any_value(n) AS n, leaf, count(leaf) AS times FROM (SELECT doc_id, len(leaves) AS n, unnest(CASE WHEN len(leaves) = 0 THEN [NULL] ELSE leaves END) AS leaf FROM ({inner})) GROUP BY doc_id, leaf"


OP3_SQL = f"""
WITH ordered AS (
    SELECT doc_id, coalesce(text, '') AS text, coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id), first_value(coalesce(text, '')) OVER (ORDER BY doc_id)) AS following FROM documents
), changed AS (
    SELECT doc_id, text, following, length(text) AS n_chars, left(text, length(text) - length(text) // 4) || left(following, length(text) // 4) AS edited FROM ordered
), digests AS (
    SELECT *, list_transform(string_split(text, chr(10)), lambda x: sha256(x)) AS p, list_transform(string_split(edited, chr(10)), lambda x: sha256(x)) AS q FROM changed
), ends AS (
    SELECT *, {_SQL_ENDS.format(p="p")} AS pe, {_SQL_ENDS.format(p="q")} AS qe FROM digests
), trees AS (
    SELECT *, {_SQL_SECTIONS.format(p="p", e="pe")} AS ps, {_SQL_SECTIONS.format(p="q", e="qe")} AS qs FROM ends
), roots AS (
    SELECT *, {_SQL_DIGESTS.format(s="ps")} AS pd, {_SQL_DIGESTS.format(s="qs")} AS qd FROM trees
), branches AS (
    SELECT doc_id, i - 1 AS section, unnest(range(1, len(qs[i]) + 1)) AS k, qs[i] AS own, list_filter(ps, lambda s: NOT list_contains(qd, sha256(array_to_string(s, '')))) AS theirs
    FROM (SELECT *, unnest(range(1, len(qs) + 1)) AS i FROM roots) WHERE NOT list_contains(pd, qd[i])
), lacking AS (
    SELECT doc_id, count(*) AS n_changed, min(section) AS changed_section, arg_min(k - 1, section * 1000000000 + k) AS changed_paragraph
    FROM branches WHERE NOT list_contains(flatten(theirs), own[k]) GROUP BY doc_id
), own AS ({_sql_leaves("text")}), edited_leaves AS ({_sql_leaves("edited")}), next_leaves AS ({_sql_leaves("following")}),
likes_edited AS ({_SQL_LIKE.format(other="edited_leaves")}), likes_next AS ({_SQL_LIKE.format(other="next_leaves")})
SELECT d.doc_id, n_chars, sha256(edited) AS edited_sha256, sha256(array_to_string(pd, '')) AS fingerprint, sha256(array_to_string(qd, '')) AS edited_fingerprint,
    e.likeness AS near_edited, n.likeness AS near_next, coalesce(n_changed, 0) AS n_changed, changed_section, changed_paragraph
FROM roots d JOIN likes_edited e USING (doc_id) JOIN likes_next n USING (doc_id) LEFT JOIN lacking USING (doc_id)
"""
