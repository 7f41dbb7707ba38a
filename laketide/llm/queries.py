"""The registered queries of this subpackage, each beside its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laketide.llm import backtrack_bpe, blas_ranking, bpe, bwt_dedup, chat_collapse, decontaminate, fm_dedup, language_ppm, licences, lm_trie, near_dedup, phrase_mining, quality_llr
from laketide.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op4_quality_llr")
def op4_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = quality_llr.learn_weights(docs, table(spark, sf_dir, "labels"))
    return quality_llr.judge(docs, weights).select("doc_id", "quality.*")


@query("op5_sketch_near_dedup")
def op5_sketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op7_fm_index_dedup")
def op7_fm_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return fm_dedup.removed(docs, with_text=False).select("doc_id", "repeats.n_words", "repeats.n_removed", "repeats.kept_sha256")


@query("op10_bwt_merge_dedup")
def op10_bwt_merge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bwt_dedup.removed(docs, with_text=False).select("doc_id", "repeats.n_bytes", "repeats.n_removed", "repeats.n_spans", "repeats.kept_sha256")


@query("op1_byte_bpe")
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row"), "text")
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.encoded(docs, ranks, public_tokenizers.PATTERN, digest=True).withColumnRenamed("row", "doc_id")


def _sql_shingles(table_name: str, key: str, k: int) -> str:
    """Distinct word shingles, A-Z lower-cased, in DuckDB."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    gram = " || ' ' || ".join(f"w[i + {j}]" for j in range(k))
    return f"""SELECT DISTINCT {key}, {gram} AS g FROM (
        SELECT {key}, w, unnest(range(1, len(w) - {k - 2})) AS i FROM (
            SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+') AS w FROM {table_name}))"""


OP9_SQL = f"""
WITH d AS ({_sql_shingles("documents", "doc_id", 5)}),
     b AS ({_sql_shingles("benchmark", "item_id", 5)}),
     n AS (SELECT item_id, count(*) AS item_shingles FROM b GROUP BY item_id)
SELECT doc_id, item_id, item_shingles, count(*) AS shared, count(*) / item_shingles AS containment
FROM d JOIN b USING (g) JOIN n USING (item_id)
GROUP BY doc_id, item_id, item_shingles
HAVING 100 * count(*) >= 80 * item_shingles"""


@query("op9_contained_items", OP9_SQL)
def op9_contained_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.pairs(docs, table(spark, sf_dir, "benchmark"))


def _remainder(modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


@query("op6_language_ppm")
def op6_language_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    trees = language_ppm.learn(docs.where(_remainder(5) != 0))
    held = F.coalesce(_remainder(5) == 0, F.lit(False))
    return language_ppm.predict(docs.select("doc_id", "text"), trees).select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query("op3_elias_fano_lm")
def op3_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row"), "doc_id", "text")
    return lm_trie.train_and_score(docs, _remainder(10) != 0).withColumnRenamed("row", "doc_id")


OP2_SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
     m AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i,
                  '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS line FROM t),
     r AS (SELECT conv_id, i, string_agg(turn || ':' || line, '') OVER (PARTITION BY conv_id ORDER BY i) AS prefix FROM m),
     s AS (SELECT conv_id, max(i) AS n FROM r GROUP BY conv_id),
     w AS (SELECT r.conv_id, n, prefix FROM r JOIN s ON r.conv_id = s.conv_id AND r.i = s.n),
     k AS (SELECT min(conv_id) AS conv_id, n FROM w
           WHERE NOT EXISTS (SELECT 1 FROM r JOIN s ON r.conv_id = s.conv_id WHERE r.i < s.n AND r.prefix = w.prefix)
           GROUP BY prefix, n)
SELECT k.conv_id, CAST(floor(turn / 256) AS BIGINT) AS part, n AS n_turns, string_agg(line, '' ORDER BY i) AS rendered
FROM k JOIN m ON k.conv_id = m.conv_id GROUP BY 1, 2, 3"""


@query("op2_chat_collapse", OP2_SQL)
def op2_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_collapse.render(table(spark, sf_dir, "conversations"))


@query("op8_licence_scan")
def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # the table has no paths and no file names: a source is a tree whose folders hold 100 and 10
    # neighbouring ids, and every licence found speaks for its folder
    deep = F.concat_ws("/", "source", F.floor(F.col("doc_id") / 100).cast("string"), F.floor(F.col("doc_id") / 10).cast("string"), F.col("doc_id").cast("string"))
    docs = docs.select("doc_id", "text", deep.alias("path"))
    return licences.scan(docs, licences.learn(docs), any_speaks=True).select("doc_id", "path", "licence.*")


@query("op11_backtrack_bpe")
def op11_backtrack_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = backtrack_bpe.read_model(public_tokenizers.path("word_bpe_49k.json"))
    return backtrack_bpe.digests(docs, model).select("doc_id", "tokens.*")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _sql_terms(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"


OP12_SQL = f"""
WITH d AS (SELECT doc_id, {_sql_terms("text")} AS w FROM documents),
     c AS (SELECT CAST(count(*) AS BIGINT) AS big_n, CAST(sum(len(w)) AS BIGINT) AS big_l FROM d WHERE len(w) > 0),
     q AS (SELECT item_id, term, CAST(count(*) AS BIGINT) AS repeats FROM (SELECT item_id, unnest({_sql_terms("text")}) AS term FROM benchmark) GROUP BY 1, 2),
     v AS (SELECT DISTINCT term FROM q),
     t AS (SELECT doc_id, term, len(w) AS n, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM d) JOIN v USING (term) GROUP BY ALL),
     f AS (SELECT term, CAST(floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM t, c GROUP BY term, big_n),
     i AS (SELECT doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // big_l))) AS impact FROM t JOIN f USING (term), c),
     s AS (SELECT item_id, doc_id, CAST(sum(repeats * impact) AS BIGINT) AS score FROM q JOIN i USING (term) GROUP BY 1, 2 HAVING sum(repeats * impact) > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s QUALIFY rank <= 10"""


@query("op12_blas_ranking", OP12_SQL)
def op12_blas_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blas_ranking.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = f"""
WITH p AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM (
         SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
     s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
     f AS (SELECT lang, phrase, size, CAST(count(*) AS BIGINT) AS a FROM (
         SELECT lang, k AS size, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM s, (SELECT unnest(range(1, 5)) AS k) WHERE i + k - 1 <= len(w))
         GROUP BY 1, 2, 3 HAVING count(*) >= 30),
     n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
     c AS (SELECT lang, phrase, size, a, string_split(phrase, ' ') AS w FROM f WHERE size >= 2),
     inside AS (SELECT lang, phrase, max(a) AS held FROM (
         SELECT lang, a, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM (SELECT lang, a, w, size, unnest(range(1, size + 1)) AS i FROM c), (SELECT unnest([2, 3]) AS k) WHERE k < size AND i + k - 1 <= size)
         GROUP BY 1, 2),
     cut AS (SELECT lang, phrase, a, k, array_to_string(w[1 : k], ' ') AS first, array_to_string(w[k + 1 : size], ' ') AS rest FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
     scored AS (SELECT cut.lang, cut.phrase, cut.a, k, x.a AS l, y.a AS r, CAST((2000000 * CAST(cut.a AS HUGEINT)) // (x.a + y.a) AS BIGINT) AS score
         FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = first JOIN f y ON y.lang = cut.lang AND y.phrase = rest),
     worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM worst JOIN n USING (lang) LEFT JOIN inside USING (lang, phrase)
WHERE held IS NULL OR 100 * held < 80 * a QUALIFY rank <= 2000"""


@query("op13_phrase_mining", OP13_SQL)
def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_mining.collocations(table(spark, sf_dir, "documents"))
