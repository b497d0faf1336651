"""Line deduplication by a deletion-neighbourhood join.

A line goes if an earlier one (by document, then place) equals it or, from ``MIN_CHARS`` characters on,
is within one edit of it: one character inserted, deleted or replaced. (In a shorter line one edit
makes another word or number, so no edit is allowed; empty lines only part paragraphs and stay.)
Lines are known by two independent 64-bit hashes and are first reduced to distinct ones with their
earliest place. Two lines within one edit of each other share either their first or their last half,
so lines none of whose halves recur are set aside, by two rounds of hashed keys (short ends first,
then exact halves with the length). The others emit every variant with one character deleted as a
hashed key: with the place of the deletion (equal keys: one replacement) and without it, next to the
whole line's own key (equal keys: one insertion). Of equal keys the earliest line is found by a
combinable minimum, the edit distance to it is verified on the texts, and the later lines go.

No key gathers its lines in one task: keys are aggregated, then joined back with skew handling.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import discard, flag_members, join_counted, join_groups, staged, with_row_id
from quillon.session import table

#: Shorter lines (in characters) only go if they are equal to an earlier one. At least twice the shorter end of _ends.
MIN_CHARS = 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _places(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(h, h2, line, at) of every line but empty ones; at orders lines by document and place. Spark's hash of several
    columns takes the first one's hash as the next one's seed, so the constant of h2 comes before the line."""
    lines = docs.select(F.col(id_col).alias("id"), "__rid", F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("pos", "line"))
    at = F.struct(F.col("id").isNull().alias("nil"), "id", F.col("__rid").alias("rid"), "pos")
    return lines.where("line <> ''").select(F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("h2"), "line", at.alias("at"))


def _ends(line: Column, min_chars: int) -> Column:
    """Hashes of a line's ends, none of a line too short for an edit. Lines within one edit share one: each end is at
    most half a line."""
    n = F.length(line)
    ends = []
    for k, takes in ((10, n <= 65), (32, n >= 65)):
        ends += [F.when(takes, F.xxhash64(F.lit(f"{side}{k}"), cut(line, F.lit(k)))) for side, cut in (("l", F.left), ("r", F.right))]
    return F.when(n >= min_chars, F.array(*ends))


def _halves(line: Column) -> Column:
    """Hashes of a line's halves with the lengths of the pair it may be in: as long, longer, shorter."""
    n = F.length(line)
    out = []
    for kind, short in (("same", n), ("more", n), ("more", n - 1)):
        half = F.floor(short / 2).cast("int")
        out += [F.xxhash64(F.lit(kind + side), short, cut(line, half)) for side, cut in (("l", F.left), ("r", F.right))]
    return F.array(*out)


def _recurring(keyed: DataFrame) -> DataFrame:
    """Distinct (h, h2) of the lines with a key (keys: array of hashes) that another line has too."""
    one = keyed.select("h", "h2", F.explode("keys").alias("k")).where("k is not null")
    many = one.groupBy("k").agg(F.count("*").alias("n")).where("n > 1")
    return join_groups(one, many, ["k"]).select("h", "h2").distinct()


def deletion_keys(line: str) -> tuple[np.ndarray, np.ndarray, np.uint64]:
    """Of a whole line, hashed: every variant with its place, every variant, the line itself. Variants'
    hashes come from prefix sums of a polynomial, so their cost grows with the line, not its square."""
    with np.errstate(over="ignore"):
        codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        v = (codes + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        v = (v ^ (v >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(v), _BASE))), dtype=np.uint64)[: len(v)]
        sums = np.concatenate(([np.uint64(0)], np.cumsum(v * power, dtype=np.uint64)))
        gone = sums[:-1] + (sums[-1] - sums[1:]) * _INVERSE
        placed = (gone + np.arange(1, len(v) + 1, dtype=np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        placed = (placed ^ (placed >> np.uint64(32))) * _BASE
        return placed, gone, sums[-1]


#: Variants that a worker gathers before it hands them on.
VARIANTS = 1 << 16


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, int, int, int]] = []
    n = 0

    def flush() -> pa.RecordBatch:
        sizes = [len(k) for k, _, _, _ in held]
        out = [np.concatenate([k for k, _, _, _ in held]).view(np.int64), *(np.repeat([x[c] for x in held], sizes) for c in (1, 2, 3))]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1].astype(np.int8)), pa.array(out[2]), pa.array(out[3])], names=["k", "role", "h", "h2"])

    for batch in batches:
        for h, h2, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            placed, gone, whole = deletion_keys(line)
            for role, keys in ((0, placed), (1, gone), (2, np.array([whole]))):
                for lo in range(0, len(keys), VARIANTS):  # a long line's in pieces
                    held.append((keys[lo : lo + VARIANTS], role, h, h2))
                    n += len(held[-1][0])
                    if n >= VARIANTS:
                        yield flush()
                        n = 0
    if held:
        yield flush()


def near_lines(distinct: DataFrame, texts) -> DataFrame:
    """(h, h2) of the distinct lines (h, h2, at, keys) that an earlier line is within one edit of.
    texts(hashes) returns (h, h2, line) for a set of them."""
    first = staged(_recurring(distinct.select("h", "h2", "keys")), "line-ends")
    lines = staged(texts(first), "lines")
    second = staged(_recurring(lines.select("h", "h2", _halves(F.col("line")).alias("keys"))), "line-halves")
    done = first, lines, second
    lines = staged(lines.join(second, ["h", "h2"]).join(distinct.select("h", "h2", "at"), ["h", "h2"]), "near-lines")
    for old in done:
        discard(old)
    keyed = staged(lines.select("h", "h2", "line").mapInArrow(_variants, "k long, role byte, h long, h2 long"), "variants")
    shared = staged(keyed.groupBy("k").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    own = join_counted(keyed, shared, ["k"]).select("k", "role", "h", "h2").join(lines.select("h", "h2", "at"), ["h", "h2"])
    own = staged(own, "shared-variants")
    discard(keyed)
    discard(shared)
    me = F.struct("at", "h", "h2")
    least = own.groupBy("k").agg(
        F.min(F.when(F.col("role") == 0, me)).alias("replaced"), F.min(F.when(F.col("role") == 1, me)).alias("longer"), F.min(F.when(F.col("role") == 2, me)).alias("shorter")
    )
    other = F.when(F.col("role") == 0, F.col("replaced")).when(F.col("role") == 1, F.col("shorter")).otherwise(F.col("longer"))
    pairs = (
        join_groups(own, least, ["k"]).withColumn("other", other).where(F.col("other.at") < F.col("at"))
        .select("h", "h2", F.col("other.h").alias("oh"), F.col("other.h2").alias("oh2")).distinct()
    )
    mine, theirs = lines.select("h", "h2", "line"), lines.select(F.col("h").alias("oh"), F.col("h2").alias("oh2"), F.col("line").alias("earlier"))
    near = staged(pairs.join(mine, ["h", "h2"]).join(theirs, ["oh", "oh2"]).where(F.levenshtein("line", "earlier", 1) >= 0).select("h", "h2").distinct(), "near-one-edit")
    discard(own)
    discard(lines)
    return near


def removed_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """(rid, gone): the places of the lines that go, for every document (__rid) that loses any."""
    places = _places(docs, text_col, id_col)
    distinct = staged(
        places.select("h", "h2", "at", _ends(F.col("line"), min_chars).alias("keys")).groupBy("h", "h2")
        .agg(F.min("at").alias("at"), F.count("*").alias("n"), F.first("keys").alias("keys")),
        "distinct-lines",
    )

    def texts(hashes: DataFrame) -> DataFrame:
        some = flag_members(places.select("h", "h2", "line"), hashes.select("h"), hashes.count()).where("again").drop("again")
        return join_groups(some, hashes, ["h", "h2"]).groupBy("h", "h2").agg(F.first("line").alias("line"))

    near = near_lines(distinct, texts)
    marked = staged(distinct.join(near.withColumn("near", F.lit(True)), ["h", "h2"], "left").where("n > 1 or near").select("h", "h2", F.col("at").alias("first"), F.coalesce("near", F.lit(False)).alias("near")), "marked-lines")
    discard(distinct)
    discard(near)
    some = flag_members(places.select("h", "h2", "at"), marked.select("h"), marked.count()).where("again").drop("again")
    gone = join_groups(some, marked, ["h", "h2"]).where("near or at <> first").select(F.col("at.rid").alias("rid"), F.col("at.pos").alias("pos"))
    return gone.groupBy("rid").agg(F.collect_list("pos").alias("gone"))


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, count_col: str | None = None) -> DataFrame:
    """Every row of ``df``, its text without the lines that go, plus n_lines and n_removed (replaced if
    they exist; ``count_col``, if given, gets the new text's length instead of both).

    Documents are ordered by id, null ids last; rows with the same id by place in the input. Lines
    under ``min_chars`` characters go only if an earlier one is equal, empty ones stay. A null text stays null, an empty one has one empty line; a
    document may lose all its lines and then has an empty text. An empty table stays empty.
    """
    docs = with_row_id(df)
    gone = removed_lines(docs, id_col, text_col, min_chars)
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    out = docs.join(gone.withColumnsRenamed({"rid": "__rid", "gone": "__gone"}), "__rid", "left").withColumn("__gone", F.coalesce("__gone", F.array().cast("array<int>")))
    out = out.withColumn("__n", F.size(lines)).withColumn(
        text_col, F.when(F.size("__gone") == 0, F.col(text_col)).otherwise(F.array_join(F.filter(lines, lambda _, i: ~F.array_contains("__gone", i)), "\n"))
    )
    if count_col:
        out = out.withColumn(count_col, F.length(text_col).cast("long"))
    else:
        out = out.withColumn("n_lines", F.col("__n").cast("long")).withColumn("n_removed", F.size("__gone").cast("long"))
    return out.drop("__rid", "__gone", "__n")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with its number of lines, of lines that go, and the text's digest after."""
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


OP7_SQL = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
c AS (SELECT *, row_number() OVER (ORDER BY doc_id, pos) AS place FROM l WHERE line <> ''),
d AS (SELECT line, min(place) AS first FROM c GROUP BY line),
f AS (SELECT * FROM d WHERE length(line) >= {MIN_CHARS}),
e AS (SELECT *, left(line, 10) AS k, 'l' AS side FROM f UNION ALL SELECT *, right(line, 10), 'r' FROM f),
p AS (SELECT DISTINCT a.line AS line, b.line AS earlier FROM e a JOIN e b ON a.k = b.k AND a.side = b.side
      WHERE b.first < a.first AND abs(length(a.line) - length(b.line)) <= 1),
near AS (SELECT DISTINCT line FROM p WHERE
      len(list_filter(range(1, least(length(line), length(earlier)) + 1), lambda i: left(line, i) = left(earlier, i)))
      + len(list_filter(range(1, least(length(line), length(earlier)) + 1), lambda i: right(line, i) = right(earlier, i)))
      >= greatest(length(line), length(earlier)) - 1),
gone AS (SELECT doc_id, pos FROM c JOIN d USING (line) WHERE place <> first OR line IN (SELECT line FROM near)),
kept AS (SELECT l.doc_id, count(*) AS n_lines, count(g.doc_id) AS n_removed,
         coalesce(string_agg(CASE WHEN g.doc_id IS NULL THEN line END, chr(10) ORDER BY l.pos), '') AS t
         FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id)
SELECT doc_id, n_lines, n_removed, sha256(t) AS text_sha256 FROM kept
"""
