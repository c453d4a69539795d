"""Queries pN_... of the training-data operators over their whole tables, with SQL where SQL can express the result."""

from __future__ import annotations

from pyspark.sql import functions as F

from chalkline.llm import markup, packing, prose, quota, scans, spam, splitting, tokens
from chalkline.queries.registry import Registry

R = Registry()
WS = r"[\s\p{Z}\x{0B}\x{1C}-\x{1F}\x{85}]"


# --- 1: text statistics --------------------------------------------------------------------------------------------------------------


@R.add()
def p1_found(t):
    rows = prose.judged(prose.statistics(t("chunks_norm")))
    return rows.filter(~F.col("verdict").isin("prose", "blank")).select("chunk_ord")


@R.add()
def p1_statistics(t):
    """All statistics with verdict and reasons, and whether the delivered n_words is the counted one."""
    rows = prose.judged(prose.statistics(t("chunks_norm"), keep=("n_words",))).withColumnRenamed("n_words", "n_given")
    return rows.withColumn("n_words_ok", F.coalesce(F.col("n_given") == F.col("n_counted"), F.lit(False)))


# --- 2: noise of scanned pages -------------------------------------------------------------------------------------------------------


@R.add()
def p2_found(t):
    rows = t("chunks_norm")
    return scans.damaged(rows, scans.learned(rows)).select("chunk_ord")


@R.add()
def p2_repaired(t):
    rows = t("chunks_norm")
    return scans.repaired(rows, scans.learned(rows))


# --- 3: sample matching target proportions -------------------------------------------------------------------------------------------

SAMPLE = rf"""targets AS (SELECT question_set, section_type, max(sample_size) AS sample_size, max(target_share) AS target_share, max(min_rows) AS min_rows, max(per_paper) AS per_paper FROM question_targets GROUP BY 1, 2),
n AS (SELECT question_id, created_at, question_set, lower(regexp_replace(section_type, '^{WS}+|{WS}+$', '', 'g')) AS s, regexp_replace(regexp_replace(arxiv_id, '^arXiv:', ''), 'v[0-9]+$', '') AS paper FROM questions),
l AS (SELECT question_id, question_set, CASE WHEN s IN ({", ".join(f"'{t}'" for t in quota.TYPES)}) THEN s ELSE 'other' END AS section_type, paper FROM n QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY created_at DESC) = 1),
u AS (SELECT l.*, t.* EXCLUDE (question_set, section_type), md5('42:' || question_id) AS h FROM l JOIN targets t USING (question_set, section_type) WHERE paper IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY question_set, section_type, paper ORDER BY md5('42:' || question_id)) <= per_paper),
p AS (SELECT *, row_number() OVER (PARTITION BY question_set, section_type ORDER BY h) AS place FROM u),
r AS (SELECT *, CASE WHEN place <= min_rows THEN place::DOUBLE WHEN target_share * sample_size > 0 THEN (place - 0.5) / (target_share * sample_size) END AS pr FROM p),
d AS (SELECT *, row_number() OVER (PARTITION BY question_set ORDER BY (place > min_rows)::INT, pr, section_type, place) AS seat FROM r WHERE pr IS NOT NULL QUALIFY seat <= sample_size),
report AS (SELECT question_set, section_type, greatest(min_rows::DOUBLE, round(target_share * sample_size, 6)) AS wanted, coalesce(c.usable, 0) AS usable, coalesce(e.drawn, 0) AS drawn
  FROM targets LEFT JOIN (SELECT question_set, section_type, count(*) AS usable FROM u GROUP BY 1, 2) c USING (question_set, section_type) LEFT JOIN (SELECT question_set, section_type, count(*) AS drawn FROM d GROUP BY 1, 2) e USING (question_set, section_type))"""


@R.add(f"WITH {SAMPLE} SELECT question_set, section_type FROM report WHERE wanted > usable")
def p3_found(t):
    """Of the types for which the draw fell short those that could not be served at all; short for want of seats alone is none."""
    report = quota.sample(t("questions"), t("question_targets"))[1]
    return report.filter("short AND unmet").select("question_set", "section_type")


@R.add(f"WITH {SAMPLE} SELECT question_set, section_type, question_id, paper, place::INT AS place, seat::INT AS seat FROM d")
def p3_sample(t):
    return quota.sample(t("questions"), t("question_targets"))[0]


@R.add(f"WITH {SAMPLE} SELECT question_set, section_type, wanted, usable, drawn, wanted > usable AS unmet, wanted > drawn AS short FROM report")
def p3_report(t):
    return quota.sample(t("questions"), t("question_targets"))[1].select("question_set", "section_type", "wanted", "usable", "drawn", "unmet", "short")


# --- 4: splitting oversized items ----------------------------------------------------------------------------------------------------


@R.add(f"SELECT chunk_ord FROM chunks_norm WHERE len(list_filter(regexp_split_to_array(text, '{WS}+'), lambda w: w <> '')) > 250")
def p4_found(t):
    split = splitting.pieces(t("chunks_norm"))
    return split.filter((F.col("piece") == 0) & (F.col("n_pieces") > 1)).select("chunk_ord")


@R.add()
def p4_pieces(t):
    rows = t("chunks_norm")
    return splitting.renumbered(splitting.pieces(rows), rows)


@R.add(f"SELECT chunk_ord, len(list_filter(regexp_split_to_array(coalesce(text, ''), '{WS}+'), lambda w: w <> '')) AS n_words, true AS within, list_filter(regexp_split_to_array(coalesce(text, ''), '{WS}+'), lambda w: w <> '')[1] AS first_word, list_filter(regexp_split_to_array(coalesce(text, ''), '{WS}+'), lambda w: w <> '')[-1] AS last_word FROM chunks_norm")
def p4_counts(t):
    """By chunk the words of its pieces without the overlaps, whether each piece is within the limit, and the first and last word."""
    p = splitting.SplitParams()
    rows = splitting.pieces(t("chunks_norm"))
    of = F.expr(f"filter(split(coalesce(piece_text, ''), '{WS}+'), w -> w <> '')".replace("\\", "\\\\"))
    rows = rows.withColumn("_w", of)
    ends = lambda pick, at: pick(F.get("_w", at), "piece")
    return rows.groupBy("chunk_ord").agg(
        (F.sum("piece_words") - p.overlap * (F.max("n_pieces") - 1)).alias("n_words"), (F.max("piece_words") <= p.limit).alias("within"),
        ends(F.min_by, F.lit(0)).alias("first_word"), ends(F.max_by, F.size("_w") - 1).alias("last_word"),
    )


# --- 5: markup residue ---------------------------------------------------------------------------------------------------------------


@R.add()
def p5_found(t):
    """Texts whose tree has marks."""
    return markup.marked(t("chunks_norm")).filter(F.col("n_residues") > 0).select("chunk_ord")


@R.add()
def p5_trees(t):
    """Marks, elements and the share of the text that the scores keep."""
    return markup.marked(t("chunks_norm"))


@R.add()
def p5_clean(t):
    return markup.cleaned(t("chunks_norm"))


# --- 6: encoding the corpus ----------------------------------------------------------------------------------------------------------


@R.add()
def p6_ids(t):
    return tokens.encoded(t("documents"))


@R.add("SELECT doc_id, md5(coalesce(text, '')) AS text, strlen(coalesce(text, ''))::BIGINT AS n_bytes, (coalesce(text, '') = '')::BOOLEAN AS no_ids FROM documents")
def p6_round_trip(t):
    """Every text from its ids back, by hash and number of bytes; null and empty texts have no ids and come back empty."""
    back = tokens.decoded(tokens.encoded(t("documents")).select("doc_id", "ids"), keep=("ids",))
    return back.select("doc_id", F.md5("text").alias("text"), F.octet_length("text").cast("bigint").alias("n_bytes"), (F.size("ids") == 0).alias("no_ids"))


# --- 7: filling containers -----------------------------------------------------------------------------------------------------------


@R.add()
def p7_packed(t):
    return packing.packed(tokens.sizes(t("documents")), t("pack_sizes"))


@R.add("SELECT pack_name, capacity::BIGINT AS capacity, (SELECT count(*) FILTER (text <> '') FROM documents) AS items, true AS whole, true AS fits, true AS tight FROM pack_sizes")
def p7_valid(t):
    """Every text with tokens is packed once and whole, no container is over its capacity, and there are hardly more than any packing needs."""
    sizes = tokens.sizes(t("documents")).checkpoint()
    return packing.validity(packing.packed(sizes, t("pack_sizes")), sizes, t("pack_sizes"))


@R.add()
def p7_report(t):
    return packing.fill_report(packing.packed(tokens.sizes(t("documents")), t("pack_sizes")), t("pack_sizes"))


# --- 8: keyword-stuffed and link-list pages ------------------------------------------------------------------------------------------


@R.add()
def p8_found(t):
    return spam.judged(t("documents"), t("common_words")).filter("is_spam").select("doc_id")


@R.add()
def p8_features(t):
    return spam.judged(t("documents"), t("common_words"))
