"""Queries of the training-data problems, over whole tables, with their SQL where that can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import defects, garbled, mixing, overlaps, packing, pieces, similar, together, tokens
from quern.runtime import Stash, table

#: Where the public tokenizers' files are; a parameter of the queries that use them.
TOKENIZERS = "/opt/tokenizers"
#: How byte_bpe_50k splits a text before merging. Fixed value.
BYTE_BPE_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _lab(spark: SparkSession, sf_dir: str):
    return tokens.piece_tokenizer(table(spark, sf_dir, "tokenizer_vocab"))


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.with_token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), _lab(spark, sf_dir))


def p1_slice_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.slice_tokens(table(spark, sf_dir, "documents"), _lab(spark, sf_dir))


def p1_slice_tokens_bpe(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    make = tokens.bpe_tokenizer(spark, f"{tokenizers}/byte_bpe_50k.tiktoken", BYTE_BPE_PATTERN)
    return tokens.slice_tokens(table(spark, sf_dir, "documents"), make)


def p1_document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.document_tokens(table(spark, sf_dir, "documents"), _lab(spark, sf_dir))


def p2_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps.split_overlaps(table(spark, sf_dir, "eval"), table(spark, sf_dir, "train_qa"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_overlaps(spark, sf_dir).select("eval_id", "train_id")


def p2_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_overlaps(spark, sf_dir).select("eval_id", "train_id", F.round("similarity", 6).alias("similarity"))


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps.overlap_report(p2_overlaps(spark, sf_dir), table(spark, sf_dir, "eval"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    sft, train_qa = table(spark, sf_dir, "sft"), table(spark, sf_dir, "train_qa")
    return defects.defects(defects.sft_pairs(sft).unionByName(defects.qa_pairs(train_qa)))


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_found(spark, sf_dir).groupBy("tbl", "defect").count().withColumnRenamed("count", "n_records")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.boundaries(pieces.split_documents(table(spark, sf_dir, "documents")))


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.split_documents(table(spark, sf_dir, "documents"))


def p4_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of each document put together again without their overlaps, and whether all of them fit."""
    rows = p4_pieces(spark, sf_dir)
    parts = F.array_sort(F.collect_list(F.struct("piece", "text")))
    own = F.transform(parts, lambda p: F.when(p["piece"] == 0, p["text"]).otherwise(F.substr(p["text"], F.lit(201))))
    return rows.groupBy("doc_id").agg(F.md5(F.array_join(own, "")).alias("digest"), (F.max("n_chars") <= 4000).alias("fits"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, links = similar.similar_classes(table(spark, sf_dir, "documents"), 0.6, 3)
    return similar.similar_pairs(members, links)


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.similar_groups(*similar.similar_classes(table(spark, sf_dir, "documents"), 0.6, 3))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = together.tied_groups(table(spark, sf_dir, "train_qa"))
    return groups.where("n_records > 1").selectExpr("id AS train_id", "group_id")


def p6_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return together.assign_splits(together.tied_groups(table(spark, sf_dir, "train_qa")), table(spark, sf_dir, "split_targets"))


def p6_split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return together.split_report(p6_splits(spark, sf_dir), table(spark, sf_dir, "split_targets"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.divided(packing.pack(_sizes(spark, sf_dir)))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_sizes(spark, sf_dir))


def p8_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the containers hold of each document, in how many parts, and whether no container is too full."""
    rows = Stash(spark).put(p8_containers(spark, sf_dir))
    full = rows.groupBy("container").agg((F.sum("n_tokens") <= 1024).alias("fits"))
    return rows.join(full, "container").groupBy("doc_id").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_parts"), F.bool_and("fits").alias("fits"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(packing.pack(_sizes(spark, sf_dir)))


def _mix(spark: SparkSession, sf_dir: str, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, sf_dir, "mix_targets")
    sizes = tokens.sliced_sizes(table(spark, sf_dir, "documents"), _lab(spark, sf_dir))
    if not exact:
        return mixing.mix(sizes, targets)
    sizes = Stash(spark).put(sizes)
    return mixing.mix(sizes, targets, mixing.exact_budget(sizes, targets))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[0].withColumn("finish", F.round("finish", 3))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[1]


def p9_exact_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the largest mix in which no source falls short of its share."""
    return _mix(spark, sf_dir, exact=True)[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled.garbled(table(spark, sf_dir, "documents")).select("doc_id")


def p10_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled.garbled(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p1_slice_tokens, p1_slice_tokens_bpe, p1_document_tokens, p2_found, p2_overlaps, p2_pairs, p2_report, p3_found, p3_counts, p4_found, p4_pieces, p4_rejoined, p5_found, p5_groups, p6_found, p6_splits, p6_split_report, p8_found, p8_containers, p8_documents, p8_fill, p9_mix, p9_shares, p9_exact_shares, p10_found, p10_restored)}

_BLANKS = "chr(32) || chr(9) || chr(13) || chr(10)"

#: Longest pieces first, then any character that isn't blank: what the tokenizer's rule comes to, as no piece holds others than letters.
_TOKENS = r"""tok AS (SELECT doc_id, text, source, lang, metadata, len(regexp_extract_all(lower(coalesce(text, '')),
    (SELECT string_agg(piece, '|' ORDER BY length(piece) DESC, piece) || '|(?s:[^ \t\r\n\x{a0}])' FROM tokenizer_vocab))) AS n FROM documents)"""


def _label(column: str) -> str:
    text = f"trim(regexp_replace(lower({column}), '[\\s\\x{{a0}}\\x{{200b}}_./\\\\-]+', '-', 'g'), '-')"
    return f"CASE WHEN coalesce({text}, '') = '' THEN '(none)' ELSE {text} END"


_SLICED = f"""{_TOKENS}, sl AS (SELECT doc_id, text, n, CASE WHEN {_label('metadata.source')} = '(none)' THEN {_label('source')} ELSE {_label('metadata.source')} END AS source,
    {_label('lang')} AS lang, {_label('metadata.topic')} AS topic FROM tok)"""

_PAIRS = r"""w AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
        s AS (SELECT doc_id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2]))) AS s FROM w),
        e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
        pairs AS (SELECT a, b, c = na AND c = nb AS same FROM p WHERE c * 5 >= 3 * (na + nb - c) UNION SELECT x.doc_id, y.doc_id, TRUE FROM w x JOIN w y ON x.text = y.text AND x.doc_id < y.doc_id)"""

_GROUPS = rf"""keys AS (
            SELECT id, 'a:' || lower(trim(metadata.author, {_BLANKS})) AS k FROM train_qa WHERE lower(trim(metadata.author, {_BLANKS})) NOT IN ('', 'unknown')
            UNION SELECT id, 'q:' || trim(regexp_replace(lower(question), '[ \t\r\n]+', ' ', 'g'), ' ') FROM train_qa WHERE trim(question, {_BLANKS}) <> ''
            UNION SELECT id, 'd:' || r FROM (SELECT id, trim(unnest(relevant_doc_ids), {_BLANKS}) AS r FROM train_qa) WHERE r <> ''),
        ties AS (SELECT DISTINCT id, min(id) OVER (PARTITION BY k) AS least FROM keys),
        edges AS (SELECT id AS a, least AS b FROM ties WHERE id <> least UNION SELECT least, id FROM ties WHERE id <> least),
        reach AS (SELECT DISTINCT a AS node, a AS root FROM edges UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.node),
        grp AS (SELECT node AS train_id, min(root) AS group_id FROM reach GROUP BY node)"""
_ASSIGNED = """ids AS (SELECT DISTINCT t.id, coalesce(g.group_id, t.id) AS group_id FROM train_qa t LEFT JOIN grp g ON g.train_id = t.id WHERE t.id IS NOT NULL),
        rng AS (SELECT split, sum(share) OVER (ORDER BY split) / sum(share) OVER () AS high FROM split_targets WHERE share > 0),
        pt AS (SELECT id, group_id, CAST('0x' || substr(sha256(concat_ws(':', '42', group_id)), 1, 13) AS BIGINT) / 4503599627370496.0 AS p FROM ids),
        asg AS (SELECT id, group_id, coalesce(min_by(split, high), (SELECT max_by(split, high) FROM rng)) AS split FROM pt LEFT JOIN rng ON p < high GROUP BY id, group_id)"""

_OVERLAPS = r"""n AS (SELECT DISTINCT 'e' AS side, id, trim(regexp_replace(lower(question), '[^\p{L}\p{N}]+', ' ', 'g'), ' ') AS q FROM eval WHERE question IS NOT NULL
                   UNION SELECT DISTINCT 't', id, trim(regexp_replace(lower(question), '[^\p{L}\p{N}]+', ' ', 'g'), ' ') FROM train_qa WHERE question IS NOT NULL),
        g AS (SELECT side, id, list_distinct(list_transform(range(1, length(q) - 1), lambda i: q[i:i + 2])) AS g FROM n WHERE length(q) >= 3),
        x AS (SELECT side, id, len(g) AS k, unnest(g) AS t FROM g),
        p AS (SELECT a.id AS a, b.id AS b, a.k AS ka, b.k AS kb, count(*) AS c FROM x a JOIN x b ON a.t = b.t AND a.side = 'e' AND b.side = 't' GROUP BY ALL)"""
def _mix_sql(budget: str) -> str:
    return f"""{_SLICED},
        sz AS (SELECT doc_id, source, n FROM sl WHERE n > 0),
        tg AS (SELECT {_label('source')} AS source, sum(target_share) AS share, max(max_repeats) AS reps FROM mix_targets GROUP BY 1),
        hv AS (SELECT tg.*, coalesce(h.n, 0) AS n FROM tg LEFT JOIN (SELECT source, sum(n) AS n FROM sz GROUP BY source) h ON h.source = tg.source),
        wt AS (SELECT *, CASE WHEN n > 0 AND share > 0 AND reps > 0 THEN share / sum(share) FILTER (n > 0 AND share > 0 AND reps > 0) OVER () END AS w FROM hv),
        bu AS (SELECT {budget} AS budget FROM wt WHERE w IS NOT NULL),
        ps AS (SELECT source, w, n AS total, unnest(range(1, reps + 1)) AS copy FROM wt WHERE w IS NOT NULL),
        cp AS (SELECT sz.doc_id, sz.source, sz.n, ps.copy, ps.w, ps.total, CAST('0x' || substr(sha256(concat_ws(':', '42', ps.copy, sz.doc_id)), 1, 15) AS BIGINT) AS h FROM sz JOIN ps ON ps.source = sz.source),
        fi AS (SELECT *, (sum(n) OVER (PARTITION BY source, copy ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) + (copy - 1) * total) / w AS finish FROM cp),
        ru AS (SELECT *, sum(n) OVER (ORDER BY finish, source, doc_id, copy ROWS UNBOUNDED PRECEDING) AS run FROM fi),
        mx AS (SELECT source, doc_id, copy, n, finish FROM ru, bu WHERE run <= budget)"""


_MIX, _EXACT = _mix_sql("sum(n)"), _mix_sql("floor(min(n * reps / w))")
_SHARES = """, us AS (SELECT source, sum(n) AS n, count(DISTINCT doc_id) AS d, max(copy) AS c FROM mx GROUP BY source)
        SELECT wt.source, wt.share AS target_share, coalesce(round(us.n / (SELECT sum(n) FROM us), 6), 0.0::DOUBLE) AS reached_share, CAST(coalesce(us.n, 0) AS BIGINT) AS n_tokens, coalesce(us.d, 0) AS n_docs, coalesce(us.c, 0) AS most_copies FROM wt LEFT JOIN us ON us.source = wt.source"""

SQL = {
    "p9_mix": f"WITH {_MIX} SELECT source, doc_id, copy, n AS n_tokens, round(finish, 3) AS finish FROM mx",
    "p9_shares": f"WITH {_MIX}{_SHARES}",
    "p9_exact_shares": f"WITH {_EXACT}{_SHARES}",
    "p2_report": f"""WITH {_OVERLAPS}, f AS (SELECT a AS id, count(DISTINCT b) AS n, max(c = ka AND c = kb) AS same FROM p WHERE c * 4 >= 3 * (ka + kb - c) GROUP BY a),
        o AS (SELECT id, min(metadata.split) AS split, min(metadata.source) AS source FROM eval WHERE id IS NOT NULL GROUP BY id)
        SELECT o.split, o.source, count(*) AS n_records, count(f.n) AS n_overlapping, count(*) FILTER (f.same) AS n_exact, CAST(coalesce(sum(f.n), 0) AS BIGINT) AS n_pairs FROM o LEFT JOIN f ON f.id = o.id GROUP BY o.split, o.source""",
    "p1_slice_tokens": f"""WITH {_SLICED}, d AS (SELECT source, lang, topic, coalesce(text, '') AS t, count(*) AS c, min(n) AS n FROM sl GROUP BY ALL)
        SELECT source, lang, topic, CAST(sum(c) AS BIGINT) AS n_docs, count(*) AS n_texts, CAST(sum(c * n) AS BIGINT) AS n_tokens, CAST(sum(n) AS BIGINT) AS n_distinct_tokens FROM d GROUP BY ALL""",
    "p1_document_tokens": f"WITH {_SLICED} SELECT doc_id, source, lang, topic, n AS n_tokens FROM sl",
    "p8_found": f"WITH {_TOKENS} SELECT doc_id FROM tok WHERE n > 1024",
    "p2_found": f"WITH {_OVERLAPS} SELECT DISTINCT a AS eval_id, b AS train_id FROM p WHERE c * 4 >= 3 * (ka + kb - c)",
    "p2_pairs": f"WITH {_OVERLAPS} SELECT a AS eval_id, b AS train_id, round(max(c / (ka + kb - c)), 6) AS similarity FROM p WHERE c * 4 >= 3 * (ka + kb - c) GROUP BY a, b",
    "p4_rejoined": "SELECT doc_id, md5(text) AS digest, TRUE AS fits FROM documents WHERE length(text) > 4000",
    "p8_documents": f"WITH {_TOKENS} SELECT doc_id, n AS n_tokens, CAST(greatest(1, ceil(n / 1024)) AS BIGINT) AS n_parts, TRUE AS fits FROM tok WHERE doc_id IS NOT NULL",
    "p4_found": r"""
        WITH d AS (SELECT doc_id, text FROM documents WHERE length(text) > 4000),
        w AS (SELECT doc_id,
            list_max(list_transform(regexp_split_to_array(text, '\r?\n([ \t]*\r?\n)+'), lambda x: length(x))) AS paragraph,
            list_max(list_transform(regexp_split_to_array(text, '\r?\n'), lambda x: length(x))) AS line,
            list_max(list_transform(regexp_split_to_array(text, '[ \t\r\n]+'), lambda x: length(x))) AS word FROM d)
        SELECT doc_id, CASE WHEN paragraph <= 4000 THEN 'paragraph' WHEN line <= 4000 THEN 'line' WHEN word <= 4000 THEN 'word' ELSE 'none' END AS boundary FROM w""",
    "p5_found": f"WITH {_PAIRS} SELECT a AS doc_id_a, b AS doc_id_b FROM pairs",
    "p5_groups": f"""WITH RECURSIVE {_PAIRS},
        bo AS (SELECT a, b, same FROM pairs UNION SELECT b, a, same FROM pairs),
        reps AS (SELECT w.doc_id, least(w.doc_id, coalesce(min(b), w.doc_id)) AS rep FROM w LEFT JOIN bo ON bo.a = w.doc_id AND same GROUP BY w.doc_id),
        links AS (SELECT DISTINCT x.rep AS a, y.rep AS b FROM bo JOIN reps x ON x.doc_id = bo.a JOIN reps y ON y.doc_id = bo.b WHERE x.rep <> y.rep),
        reach AS (SELECT doc_id AS node, doc_id AS root FROM w UNION SELECT bo.b, r.root FROM reach r JOIN bo ON bo.a = r.node)
        SELECT reps.doc_id, reps.rep, min(root) AS group_id, (SELECT count(*) FROM links WHERE links.a = reps.rep) AS n_links FROM reps JOIN reach ON reach.node = reps.doc_id GROUP BY ALL""",
    "p6_found": f"WITH RECURSIVE {_GROUPS} SELECT train_id, group_id FROM grp",
    "p6_splits": f"WITH RECURSIVE {_GROUPS}, {_ASSIGNED} SELECT id, group_id, split FROM asg",
    "p6_split_report": f"""WITH RECURSIVE {_GROUPS}, {_ASSIGNED}
        SELECT t.split, t.share, count(a.id) AS n_records, count(DISTINCT a.group_id) AS n_groups, round(count(a.id) / (SELECT count(*) FROM asg), 6) AS reached_share FROM split_targets t LEFT JOIN asg a ON a.split = t.split GROUP BY t.split, t.share""",
}
