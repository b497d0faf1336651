"""License scan: an exact set-similarity join between text blocks and license templates.

A text is cut into blocks of ``width`` words that start every ``stride`` words, wide enough that any
template-long passage lies whole in the block that owns its first word. A block's tokens that occur
in some template are put in the global order (rarest in the corpus first; the counts come from all
rows). A block joins a template when it contains at least ``alpha`` of the template's distinct
tokens. Candidates share a token with the template's prefix (its rarest size - alpha + 1
tokens): an index from prefix tokens to templates gives each block the templates to try. They must hold alpha tokens at all (length filter), and have enough tokens left behind the shared one
on both sides (positional filter); the overlap of those that remain is then counted exactly.

Templates are a fixed registry, so the join's small side is a set of plan literals and no row is
shuffled: every text is matched where it was read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import ascii_lower
from quillon.session import table

#: What stands between words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """A label, its words, and the share of its distinct tokens a block must hold. A phrase counts
    only where its words stand consecutively."""

    label: str
    text: str
    share: float = 0.8
    phrase: bool = False


# License phrases and notices.
TEMPLATES = (
    Template("mit", "under the mit license", 1.0, True),
    Template("apache-2", "apache license version 2", 1.0, True),
    Template("cc-by-nc", "cc by nc", 1.0, True),
    Template("gpl-3", "licensed under the gnu general public license version 3"),
    Template("apache-2", "licensed under the apache license version 2 0"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that"),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
)


def _alpha(t: Template) -> int:
    n = len(set(t.text.split()))
    return max(1, -(-round(n * t.share * 1000) // 1000))


def _words(text_col: str):
    """The words of a whole text, as what stands between separators; regexp_extract_all, which makes a match of each, takes many times as long."""
    return F.array_remove(F.split(ascii_lower(F.col(text_col)), SEPARATORS), "")


def token_order(df: DataFrame, text_col: str, vocabulary: list[str]) -> list[str]:
    """The vocabulary, rarest in the corpus first; ties in code point order. One row a token comes
    to the driver, so at most the vocabulary's size."""
    counts = (
        df.select(F.explode(_words(text_col)).alias("w")).where(F.col("w").isin(vocabulary)).groupBy("w").agg(F.count("*").alias("n")).collect()
    )
    n = {r["w"]: r["n"] for r in counts}
    return sorted(vocabulary, key=lambda w: (n.get(w, 0), w))


def _list(words) -> str:
    return "array(" + ",".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def _template_literal(t: Template, rank: dict[str, int]) -> str:
    tokens = sorted(set(t.text.split()), key=rank.__getitem__)
    alpha, size = _alpha(t), len(tokens)
    prefix = ",".join(f"named_struct('tok','{w}','rest',{size - 1 - i})" for i, w in enumerate(tokens[: size - alpha + 1]))
    return (
        f"named_struct('label','{t.label}','phrase',{str(t.phrase).lower()},'words',{_list(t.text.split())},'len',{len(t.text.split())},"
        f"'tokens',{_list(tokens)},'alpha',{alpha},'prefix',array({prefix}))"
    )


def license_scan(
    df: DataFrame, text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES, stride: int = 16, out: str = "licenses"
) -> DataFrame:
    """Adds a struct column ``out`` (replaced if it exists) to every row: n_words, places (label,
    first word of each consecutive phrase) and matches (label, block, share of the template found).

    A null or empty text has no words and no matches; very long texts are scanned whole. Rows are independent: repeated rows, nulls and
    columns of any name pass through. An empty table stays empty.
    """
    vocabulary = sorted({w for t in templates for w in t.text.split()})
    order = token_order(df, text_col, vocabulary)
    rank = {w: i for i, w in enumerate(order)}
    width = stride + max(len(t.text.split()) for t in templates) - 1
    prefixes = [sorted(set(t.text.split()), key=rank.__getitem__)[: len(set(t.text.split())) - _alpha(t) + 1] for t in templates]
    anchors = sorted({w for p in prefixes for w in p})
    index = "map(" + ",".join(f"'{w}',array({','.join(str(i + 1) for i, p in enumerate(prefixes) if w in p)})" for w in anchors) + ")"
    registry = f"array({','.join(_template_literal(t, rank) for t in templates)})"
    tried = f"transform(array_distinct(flatten(transform(array_intersect(x.s, {_list(anchors)}), w -> element_at({index}, w)))), i -> element_at({registry}, i))"
    blocks = F.expr(
        f"""filter(transform(transform(sequence(0, greatest(cast(ceil(size(__words) / {stride}D) as int) - 1, 0)),
              k -> named_struct('k', k, 'b', slice(__words, k * {stride} + 1, {width}))),
              x -> named_struct('k', x.k, 'b', x.b, 's', if(arrays_overlap(x.b, {_list(anchors)}), array_intersect({_list(order)}, x.b), array()))),
              x -> size(x.s) > 0)"""
    )
    joined = F.expr(
        f"""filter(transform(__blocks, x -> named_struct('k', x.k, 'b', x.b, 't',
              transform(filter({tried},
                t -> size(x.s) >= t.alpha
                 and exists(t.prefix, p -> array_position(x.s, p.tok) > 0 and 1 + least(p.rest, size(x.s) - array_position(x.s, p.tok)) >= t.alpha)
                 and size(array_intersect(t.tokens, x.s)) >= t.alpha),
                t -> named_struct('label', t.label, 'phrase', t.phrase, 'words', t.words, 'len', t.len,
                                  'share', size(array_intersect(t.tokens, x.s)) / cast(size(t.tokens) as double))))),
              x -> size(x.t) > 0)"""
    )
    found = F.expr(
        f"""named_struct('n_words', cast(size(__words) as long),
              'places', flatten(transform(__joined, x -> flatten(transform(filter(x.t, t -> t.phrase), t ->
                  transform(filter(sequence(0, {stride - 1}), i -> slice(x.b, i + 1, t.len) = t.words),
                            i -> named_struct('label', t.label, 'word', cast(x.k * {stride} + i as long))))))),
              'matches', flatten(transform(__joined, x -> transform(filter(x.t, t -> not t.phrase), t ->
                  named_struct('label', t.label, 'block', cast(x.k as long), 'share', t.share)))))"""
    )
    return (
        df.withColumn("__words", _words(text_col)).withColumn("__blocks", blocks).withColumn("__joined", joined)
        .withColumn(out, found).drop("__words", "__blocks", "__joined")
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over every whole text of ``documents``. score is 1 where a phrase stands,
    else the largest share of a matched template, else 0."""
    out = license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.col("licenses.n_words").alias("n_words"),
        F.size("licenses.places").cast("long").alias("n_base"),
        F.array_min("licenses.places.word").alias("first_word"),
        F.array_max("licenses.places.word").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("licenses.places.label")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("licenses.places.label", "licenses.matches.label")), ",").alias("labels"),
        F.when(F.size("licenses.places") > 0, 1.0).otherwise(F.coalesce(F.array_max("licenses.matches.share"), F.lit(0.0))).alias("score"),
    )


def _op1_sql(stride: int = 16) -> str:
    width = stride + max(len(t.text.split()) for t in TEMPLATES) - 1
    listed = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    phrases = ", ".join(f"('{t.label}', {listed(t.text.split())})" for t in TEMPLATES if t.phrase)
    notices = ", ".join(f"('{t.label}', {listed(sorted(set(t.text.split())))}, {_alpha(t)})" for t in TEMPLATES if not t.phrase)
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
p(label, ph) AS (VALUES {phrases}), t(label, toks, alpha) AS (VALUES {notices}),
pos AS (SELECT doc_id, ws, unnest(range(len(ws))) AS i FROM d),
places AS (SELECT doc_id, label, i FROM pos JOIN p ON ws[i + 1] = ph[1] AND ws[i + 1 : i + len(ph)] = ph),
base AS (SELECT doc_id, count(*) AS n, min(i) AS lo, max(i) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS ls FROM places GROUP BY doc_id),
blocks AS (SELECT doc_id, ws[k * {stride} + 1 : k * {stride} + {width}] AS b
           FROM (SELECT doc_id, ws, unnest(range(greatest(cast(ceil(len(ws) / {stride}.0) AS BIGINT), 1))) AS k FROM d)),
m AS (SELECT doc_id, label, len(list_intersect(toks, b)) / len(toks)::DOUBLE AS share FROM blocks, t WHERE len(list_intersect(toks, b)) >= alpha),
best AS (SELECT doc_id, max(share) AS share FROM m GROUP BY doc_id),
lab AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS ls FROM (SELECT doc_id, label FROM m UNION SELECT doc_id, label FROM places) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, lo AS first_word, hi AS last_word,
       coalesce(base.ls, '') AS base_labels, coalesce(lab.ls, '') AS labels,
       CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0) END AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN lab USING (doc_id)
"""


OP1_SQL = _op1_sql()
