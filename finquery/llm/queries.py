"""Queries of the training-data operators: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finquery.llm.alignment import alignment
from finquery.llm.fingerprint_index import remove_repeats
from finquery.llm.license_rules import licences
from finquery.llm.mixing import mixed_rates
from finquery.llm.ngram_join import jaccard_components
from finquery.llm.packing import packed
from finquery.llm.pii import personal_data_digest
from finquery.llm.prefix_trie import prefix_trie
from finquery.llm.quality_mcd import quality_rules
from finquery.llm.separator_scan import token_counts
from finquery.llm.template_decontam import decontaminated
from finquery.llm.token_output import token_output
from finquery.llm.url_rules import RULES, rule_table, url_rules


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark, documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2")


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences(documents(spark, sf_dir))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document by a scan for ``<|endoftext|>`` (49407)."""
    return token_counts(spark, documents(spark, sf_dir), tokenizer_path(), end_id=49407).select("doc_id", "file", "ordinal", "start", "n_tokens", "ended")


def op4_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(spark, documents(spark, sf_dir), width=13)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op5_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark, documents(spark, sf_dir), width=3, percent=90)


def op6_decontaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminated(spark, documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), one_to_one=False, stretches=True)


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"), rule_table(spark, RULES))


def op8_mixed_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = mixed_rates(spark, documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rates.select("doc_id", "n_tokens", *(F.round(c, 6).alias(c) for c in ("p_clean", "p_low", "p_toxic", "rate")))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(spark, documents(spark, sf_dir), tokenizer_path(), end_id=1)


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data_digest(documents(spark, sf_dir))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark, spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = pa.array([zlib.crc32(x.as_buffer()) for x in batch.column("ids")], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")), crc], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32"])

    pieces = packed(spark, documents(spark, sf_dir), tokenizer_path(), size=2048, end_id=1)
    return pieces.mapInArrow(digest, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids_crc32 long")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(spark, documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))[0]


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # at the repository's top, beside the driver entry

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    operators = (op1_quality_rules, op2_licences, op3_token_counts, op4_remove_repeats, op5_jaccard_components, op6_decontaminated, op7_url_rules, op8_mixed_rates, op9_token_output, op10_personal_data, op11_prefix_trie, op12_packing, op13_alignment)
    return {f.__name__: f for f in (*operators, pipeline)}


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The words of a text, as a list.
WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def oracle_sql() -> dict[str, str]:
    """Where SQL can say what an operator returns; the others are tested against brute force."""
    rules = ", ".join(f"('{v}', '{r}', '{r.split('/', 1)[0]}', '/{r.split('/', 1)[1]}')" for v, r in RULES)
    return {
        "op4_remove_repeats": f"""
            WITH d AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS words FROM documents),
            t AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM d)),
            f AS (SELECT win, min(doc_id) AS least FROM t GROUP BY win),
            c AS (SELECT DISTINCT doc_id, i + j AS pos FROM t JOIN f USING (win), range(0, 13) r(j) WHERE least < doc_id),
            w AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM d),
            k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept, count(*) AS n FROM w ANTI JOIN c USING (doc_id, pos) GROUP BY doc_id)
            SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
        "op5_jaccard_components": f"""
            WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format(f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} AS words FROM documents),
            s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' ')))) END AS sh FROM d),
            g AS (SELECT sh, min(doc_id) AS rep, len(sh) AS n FROM s WHERE len(sh) > 0 GROUP BY sh),
            x AS (SELECT rep, n, unnest(sh) AS one FROM g),
            p AS (SELECT a.rep AS u, b.rep AS v FROM x a JOIN x b ON a.one = b.one AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
            e AS (SELECT u, v FROM p UNION ALL SELECT v, u FROM p),
            r AS (SELECT rep AS node, rep AS seen FROM g UNION SELECT r.node, e.v FROM r JOIN e ON e.u = r.seen),
            c AS (SELECT node, min(seen) AS comp FROM r GROUP BY node)
            SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(c.comp, s.doc_id) AS component_id FROM s LEFT JOIN g ON g.sh = s.sh LEFT JOIN c ON c.node = g.rep""",
        "op11_prefix_trie": """
            WITH c AS (
                SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS base, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
                    lambda crc, b: list_reduce(list_prepend(xor(crc, b), CAST(range(8) AS BIGINT[])), lambda x, k: xor(x >> 1, 3988292384 * (x & 1))))) % 6 AS h
                FROM conversations WHERE conv_id IS NOT NULL),
            t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS pos FROM conversations WHERE conv_id IS NOT NULL),
            r AS (
                SELECT c.conv_id, 1 AS part, pos, role, text FROM c JOIN t ON t.conv_id = c.base AND pos <= h
                UNION ALL SELECT c.conv_id, 2, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h),
            l AS (SELECT c.conv_id, coalesce(list({'role': role, 'text': text} ORDER BY part, pos) FILTER (WHERE part IS NOT NULL), []) AS turns FROM c LEFT JOIN r USING (conv_id) GROUP BY c.conv_id),
            p AS (SELECT conv_id, len(turns) AS last, unnest(range(0, len(turns) + 1)) AS depth, turns FROM l),
            m AS (SELECT conv_id, depth, last, sha256(CAST(to_json(turns[1:depth]) AS VARCHAR)) AS node, CASE WHEN depth > 0 THEN sha256(CAST(to_json(turns[1:depth - 1]) AS VARCHAR)) END AS parent, CASE WHEN depth > 0 THEN length(turns[depth].text) ELSE 0 END AS n FROM p),
            g AS (SELECT node, depth, any_value(parent) AS parent, min(conv_id) AS owner, count(*) AS n_convs, (count(*) - 1) * any_value(n) AS saved, max(last) = depth AS leaf,
                sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE last = depth), '')) AS ends_sha256 FROM m GROUP BY node, depth),
            below AS (SELECT DISTINCT a.node AS top, a.depth AS top_depth, b.node, b.depth FROM m a JOIN m b ON a.conv_id = b.conv_id AND b.depth >= a.depth),
            s AS (SELECT top, top_depth, CAST(sum(saved) AS BIGINT) AS saved_tokens, count(*) FILTER (WHERE leaf) AS n_leaves, count(*) FILTER (WHERE g.depth = top_depth + 1) AS n_children FROM below JOIN g USING (node, depth) GROUP BY top, top_depth)
            SELECT g.owner AS conv_id, CAST(g.depth AS BIGINT) AS depth, up.owner AS parent_conv_id, g.n_convs, s.n_children, s.n_leaves, s.saved_tokens, g.ends_sha256
            FROM g JOIN s ON s.top = g.node AND s.top_depth = g.depth LEFT JOIN g up ON up.node = g.parent AND up.depth = g.depth - 1""",
        "op7_url_rules": f"""
            WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
            r(verdict, rule, rhost, rpath) AS (VALUES {rules}),
            m AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM u JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
            SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN m USING (page_id)""",
    }
