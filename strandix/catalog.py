"""Queries of the reference's own operators over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandix.config import IngestOptions, PromptOptions, RankingOptions
from strandix.functions import text as T
from strandix.functions import vectors as V
from strandix.operators import chunks as C
from strandix.operators import embedding as E
from strandix.operators import evaluate, keywords, prompts
from strandix.operators.search import select_diverse
from strandix.plans.qa import Retriever
from strandix.sources.tables import shared_path, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
QUESTION = "estion the the ndble thend"
PROMPT = PromptOptions(system_prompt="Answer from the context and cite it.")


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{d}/{name}.parquet"))


def documents(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select(F.col("doc_id").alias("doc_ord"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("source"), F.col("text").alias("content"))


def whole(spark: SparkSession, d: str) -> DataFrame:
    """Every document as one chunk, its language as heading."""
    return read(spark, d, "documents").select(F.col("doc_id").alias("ord"), F.concat_ws("#", "source", "doc_id").alias("id"), "source", F.col("doc_id").cast("int").alias("chunk_index"), F.col("lang").alias("heading"), F.col("text").alias("content"))


def store(spark: SparkSession, d: str) -> DataFrame:
    """Every document with a vector: there are fewer vectors than documents, so they are dealt out again and again."""
    vectors = read(spark, d, "embeddings")
    n = max(1, vectors.count())
    return whole(spark, d).withColumn("vec_id", F.pmod("ord", F.lit(n))).join(vectors.select("vec_id", "embedding"), "vec_id").drop("vec_id")


_RETRIEVERS: dict[tuple[str, str], Retriever] = {}


def retriever(spark: SparkSession, d: str) -> Retriever:
    """The tables' retriever, cached as a service would hold it; the two last asked for are kept."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _RETRIEVERS:
        while len(_RETRIEVERS) > 1:
            old = next(iter(_RETRIEVERS))
            gone = _RETRIEVERS.pop(old)
            if old[0] == key[0]:
                gone.free()
        _RETRIEVERS[key] = Retriever.of(store(spark, d))
    return _RETRIEVERS[key]


def pool(spark: SparkSession, d: str, questions: DataFrame, options: RankingOptions = RankingOptions()) -> DataFrame:  # noqa: B008
    return retriever(spark, d).search(questions, options)


def hits(spark: SparkSession, d: str, questions: DataFrame, options: RankingOptions = RankingOptions()) -> DataFrame:  # noqa: B008
    return select_diverse(pool(spark, d, questions, options), options.per_source_limit, options.top_k)


def one_question(spark: SparkSession, d: str, text: str = QUESTION) -> DataFrame:
    return read(spark, d, "embeddings").where("vec_id = 0").select(F.col("vec_id").alias("question_id"), F.lit(text).alias("question"), "embedding")


def benchmark_questions(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "benchmark").join(read(spark, d, "embeddings"), F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("question_id"), F.col("text").alias("question"), "embedding")


_TOKENS = "regexp_extract_all(lower({}), '[a-z0-9]+')"
_POSTINGS = f"""
tok AS (
  SELECT ord, unnest({_TOKENS.format("content")}) AS term, 1 AS c, 0 AS h FROM chunk UNION ALL SELECT ord, unnest({_TOKENS.format("heading")}), 0, 1 FROM chunk
), post AS (SELECT ord, term, sum(c)::INTEGER AS content_tf, sum(h)::INTEGER AS heading_tf FROM tok GROUP BY ord, term),
dl AS (SELECT ord, sum(c) AS ct, sum(h) AS ht FROM tok GROUP BY ord),
st AS (SELECT (SELECT count(*) FROM chunk) AS n, (SELECT sum(c) FROM tok) AS tc, (SELECT sum(h) FROM tok) AS th)
"""
_WHOLE = "chunk AS (SELECT doc_id AS ord, source || '#' || doc_id AS id, source, doc_id::INTEGER AS chunk_index, lang AS heading, text AS content FROM documents)"
_STORE = "chunk AS (SELECT doc_id AS ord, source || '#' || doc_id AS id, source, doc_id::INTEGER AS chunk_index, lang AS heading, text AS content, embedding FROM documents JOIN embeddings ON vec_id = doc_id % (SELECT count(*) FROM embeddings))"
_ONE = "q AS (SELECT vec_id AS question_id, '{}' AS question, embedding AS qe FROM embeddings WHERE vec_id = 0)"
_BENCH = "q AS (SELECT item_id AS question_id, text AS question, embedding AS qe FROM benchmark JOIN embeddings ON vec_id = item_id)"


def _bm25(repeat: int = 2) -> str:
    df = "post WHERE content_tf > 0" if repeat == 0 else "post"
    return f"""
qt AS (SELECT question_id, term, count(*) AS qtf FROM (SELECT question_id, unnest({_TOKENS.format("question")}) AS term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM {df} GROUP BY term),
bm AS (SELECT question_id, ord, sum(qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (content_tf + heading_tf * {repeat}) * 2.2::DOUBLE
    / (content_tf + heading_tf * {repeat} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * (ct + ht * {repeat}) / ((tc + th * {repeat})::DOUBLE / n)))) AS raw
  FROM qt JOIN post USING (term) JOIN df USING (term) JOIN dl USING (ord), st WHERE content_tf + heading_tf * {repeat} > 0 GROUP BY ALL),
mx AS (SELECT question_id, max(raw) AS m FROM bm GROUP BY question_id)
"""


def _search(weight: float = 0.3, least: float = 0, pool: int = 8, per: int = 2, top: int = 4, repeat: int = 2) -> str:
    return f"""
{_POSTINGS}, {_bm25(repeat)},
sc AS (SELECT q.question_id, c.ord, list_dot_product(c.embedding::DOUBLE[], q.qe::DOUBLE[]) AS v, {'coalesce(bm.raw / nullif(mx.m, 0), 0)' if weight else '0::DOUBLE'} AS k
  FROM chunk c CROSS JOIN q LEFT JOIN bm ON bm.ord = c.ord AND bm.question_id = q.question_id LEFT JOIN mx ON mx.question_id = q.question_id),
fused AS (SELECT *, round({1 - weight}::DOUBLE * v + {weight}::DOUBLE * k, 9) AS score FROM sc),
pool AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, ord) AS rank FROM fused {f"WHERE score >= {least}" if least > 0 else ""} QUALIFY rank <= {pool}),
cand AS (SELECT p.question_id, p.rank, p.ord, c.id, c.source, c.chunk_index, c.heading, c.content, p.score, round(p.v, 9) AS vector_score, round(p.k, 9) AS keyword_score FROM pool p JOIN chunk c USING (ord)),
capped AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY question_id, source ORDER BY rank) AS rn FROM cand) WHERE rn <= {per}),
hits AS (SELECT * REPLACE (row_number() OVER (PARTITION BY question_id ORDER BY rank) AS rank) FROM capped QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY capped.rank) <= {top})
"""


_OUT = "SELECT question_id, rank::INTEGER AS rank, ord, id, source, score, vector_score, keyword_score FROM"


def shown(rows: DataFrame) -> DataFrame:
    return rows.select("question_id", "rank", "ord", "id", "source", "score", F.round("vector_score", 9).alias("vector_score"), F.round("keyword_score", 9).alias("keyword_score"))


@query(f"SELECT doc_id, len({_TOKENS.format('text')})::INTEGER AS n_tokens, len(list_distinct({_TOKENS.format('text')}))::INTEGER AS n_terms FROM documents")
def tokenize_counts(spark, d):
    tokens = T.tokenize(F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.size(tokens).alias("n_tokens"), F.size(F.array_distinct(tokens)).alias("n_terms"))


@query(f"WITH {_WHOLE}, {_POSTINGS} SELECT ord, term, content_tf, heading_tf FROM post")
def keyword_postings(spark, d):
    return keywords.postings(whole(spark, d)).select("ord", "term", "content_tf", "heading_tf")


@query(f"WITH {_WHOLE}, {_POSTINGS} SELECT term, count(*) FILTER (content_tf > 0) AS df_content, count(*) AS df_any FROM post GROUP BY term")
def term_document_frequency(spark, d):
    return keywords.doc_freq(keywords.postings(whole(spark, d)))


@query(f"WITH {_WHOLE}, {_POSTINGS} SELECT n, tc::BIGINT AS total_content_tokens, th::BIGINT AS total_heading_tokens, (tc + 2 * th)::DOUBLE / n AS mean_length FROM st")
def corpus_stats(spark, d):
    return keywords.corpus(whole(spark, d)).withColumn("mean_length", (F.col("total_content_tokens") + 2 * F.col("total_heading_tokens")) / F.col("n"))


@query(f"SELECT item_id AS question_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({_TOKENS.format('text')}) AS term FROM benchmark) GROUP BY ALL")
def query_term_counts(spark, d):
    return keywords.question_terms(read(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question")))


_TRIM = r"regexp_replace({}, '^[\s\x{{00A0}}\x{{FEFF}}\x{{2028}}\x{{2029}}\x{{3000}}]+|[\s\x{{00A0}}\x{{FEFF}}\x{{2028}}\x{{2029}}\x{{3000}}]+$', '', 'g')"


def _split(text: str, size: int = 600, overlap: int = 80) -> str:
    step = size - overlap
    return f"CASE WHEN length({text}) <= {size} THEN [{text}] ELSE list_filter(list_transform(range(0, ceil((length({text}) - {size}) / {step}::DOUBLE)::INTEGER + 1), lambda i: {_TRIM.format(f'substring({text}, (i * {step} + 1)::INTEGER, {size})')}), lambda x: x <> '') END"


@query(f"SELECT doc_id, (unnest(range(1, len(c) + 1)) - 1)::INTEGER AS chunk_index, unnest(c) AS content FROM (SELECT doc_id, {_split('text')} AS c FROM documents)")
def hard_split_chunks(spark, d):
    return read(spark, d, "documents").select("doc_id", F.posexplode(T.hard_split(F.col("text"), 600, 80)).alias("chunk_index", "content"))


@query(f"SELECT doc_id, {_TRIM.format('text')} AS a, 'x' AS b FROM documents")
def white_space_trim(spark, d):
    padded = F.concat(F.lit("　 \n\t "), "text", F.lit(" ﻿ \r\n"))
    return read(spark, d, "documents").select("doc_id", T.text_trim(padded).alias("a"), T.text_trim(F.lit(" x ")).alias("b"))


_PACKED = f"""
par AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_TRIM.format("x")}), lambda x: x <> '') AS p FROM documents),
step AS (
  SELECT doc_id, p, 1 AS pos, ''::VARCHAR AS buf, []::VARCHAR[] AS out FROM par
  UNION ALL
  SELECT doc_id, p, pos + 1,
    CASE WHEN length(buf) + length(p[pos]) + 2 <= 300 THEN CASE WHEN buf <> '' THEN buf || chr(10) || chr(10) || p[pos] ELSE p[pos] END WHEN length(p[pos]) > 300 THEN '' ELSE p[pos] END,
    CASE WHEN length(buf) + length(p[pos]) + 2 <= 300 THEN out ELSE list_concat(list_concat(out, CASE WHEN buf <> '' THEN [buf] ELSE [] END), CASE WHEN length(p[pos]) > 300 THEN {_split("p[pos]", 300, 40)} ELSE [] END) END
  FROM step WHERE pos <= len(p)
), packed AS (SELECT doc_id, list_concat(out, CASE WHEN buf <> '' THEN [buf] ELSE [] END) AS c FROM step WHERE pos > len(p))
"""


@query(f"WITH RECURSIVE {_PACKED} SELECT doc_id, (unnest(range(1, len(c) + 1)) - 1)::INTEGER AS chunk_index, '' AS heading, unnest(c) AS content FROM packed")
def packed_chunks(spark, d):
    spaced = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))
    return read(spark, d, "documents").select("doc_id", F.posexplode(T.split_semantic(spaced, 300, 40)).alias("chunk_index", "c")).select("doc_id", "chunk_index", "c.heading", "c.content")


@query(
    f"WITH RECURSIVE {_PACKED}, h AS (SELECT doc_id, list_concat(list_transform(c, lambda x: {{'heading': lang || ' > ' || source, 'content': x}}), [{{'heading': lang || ' > tail', 'content': 'end of ' || doc_id}}]) AS c FROM packed JOIN documents USING (doc_id)) "
    "SELECT doc_id, (i - 1)::INTEGER AS chunk_index, c[i].heading AS heading, c[i].content AS content FROM (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS i FROM h)"
)
def heading_chunks(spark, d):
    md = F.concat(F.lit("# "), "lang", F.lit("\r\n### "), "source", F.lit(" \n"), F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")), F.lit("\n## tail\nend of "), F.col("doc_id").cast("string"))
    return read(spark, d, "documents").select("doc_id", F.posexplode(T.split_semantic(md, 300, 40)).alias("chunk_index", "c")).select("doc_id", "chunk_index", "c.heading", "c.content")


_CHUNKS = f"""
ch AS (SELECT doc_id AS doc_ord, source || '/' || doc_id AS source, unnest(range(1, len(c) + 1)) - 1 AS i, unnest(c) AS content
  FROM (SELECT doc_id, source, {_split(_TRIM.format("text"))} AS c FROM documents WHERE {_TRIM.format("text")} <> ''))
"""


@query(f"WITH {_CHUNKS} SELECT source || '#' || i AS id, source, i::INTEGER AS chunk_index, '' AS heading, sha1(content) AS hash, len({_TOKENS.format('content')})::INTEGER AS kw_content_count FROM ch")
def chunk_records(spark, d):
    return C.build_chunks(documents(spark, d)).select("id", "source", "chunk_index", "heading", "hash", "kw_content_count")


@query("SELECT doc_id, sha1(lang || chr(10) || lang || chr(10) || text) AS hash, sha1(text) AS plain, length(lang || chr(10) || text)::INTEGER AS n FROM documents")
def embedding_text_hash(spark, d):
    build = lambda w: T.headed(F.col("lang"), F.col("text"), w)
    return read(spark, d, "documents").select("doc_id", F.sha1(F.encode(build(2.8), "UTF-8")).alias("hash"), F.sha1(F.encode(build(0.5), "UTF-8")).alias("plain"), F.length(build(1)).alias("n"))


def _cache(spark, d):
    """An old store's vectors by hash: of texts that repeat, the last counts."""
    return read(spark, d, "documents").join(read(spark, d, "embeddings"), F.col("doc_id") == F.col("vec_id")).select(F.col("doc_id").alias("ord"), F.sha1(F.encode("text", "UTF-8")).alias("hash"), "embedding")


def _hashed(spark, d):
    return read(spark, d, "documents").select("doc_id", F.sha1(F.encode("text", "UTF-8")).alias("hash"))


_CACHE = "cache AS (SELECT sha1(text) AS hash, arg_max(embedding, doc_id) AS e FROM documents JOIN embeddings ON vec_id = doc_id GROUP BY 1), hashed AS (SELECT doc_id, sha1(text) AS hash FROM documents)"


@query(f"WITH {_CACHE} SELECT doc_id, hash, e[1]::DOUBLE AS first, e[64]::DOUBLE AS last FROM hashed JOIN cache USING (hash)")
def embedding_cache_hits(spark, d):
    return E.hits(_hashed(spark, d), _cache(spark, d)).select("doc_id", "hash", F.get("embedding", F.lit(0)).cast("double").alias("first"), F.get("embedding", F.lit(63)).cast("double").alias("last"))


@query(f"WITH {_CACHE} SELECT doc_id, hash FROM hashed ANTI JOIN cache USING (hash)")
def embedding_cache_misses(spark, d):
    return E.misses(_hashed(spark, d), _cache(spark, d)).select("doc_id", "hash")


@query("SELECT vec_id, (i - 1)::INTEGER AS i, round(v[i] / sqrt(list_dot_product(v, v)), 9) AS x FROM (SELECT vec_id, list_transform(embedding, lambda x: 3 * x::DOUBLE) AS v, unnest(range(1, 65)) AS i FROM embeddings)")
def vector_normalize(spark, d):
    v = V.normalize(F.transform("embedding", lambda x: 3 * x.cast("double")))
    return read(spark, d, "embeddings").select("vec_id", F.posexplode(v).alias("i", "x")).select("vec_id", "i", F.round("x", 9).alias("x"))


@query("SELECT count(*) AS n, 64 AS dim, (SELECT count(*) FROM embeddings WHERE label % 3 = 0) AS n_broken FROM embeddings WHERE label % 3 <> 0")
def valid_embedding_filter(spark, d):
    e = F.when(F.col("label") % 6 == 0, F.slice("embedding", 1, 63)).when(F.col("label") % 3 == 0, F.concat(F.slice("embedding", 1, 63), F.array(F.lit(float("nan")).cast("float")))).otherwise(F.col("embedding"))
    rows = read(spark, d, "embeddings").select(e.alias("e"))
    return rows.agg(F.count_if(V.is_valid(F.col("e"), 64)).alias("n"), F.max(F.when(V.is_valid(F.col("e"), 64), F.size("e"))).alias("dim"), F.count_if(~V.is_valid(F.col("e"), 64)).alias("n_broken"))


@query("SELECT min(len(embedding))::INTEGER AS dim, count(*) AS n FROM embeddings")
def embedding_dimension(spark, d):
    rows = read(spark, d, "embeddings")
    return rows.agg(F.lit(E.dimension(rows)).alias("dim"), F.count("*").alias("n"))


@query(f"WITH {_STORE}, {_ONE.format(QUESTION)}, {_search(weight=0)} {_OUT} cand")
def vector_topk(spark, d):
    return shown(pool(spark, d, one_question(spark, d), RankingOptions(keyword_weight=0)))


@query(f"WITH {_STORE}, {_ONE.format(QUESTION)}, {_search(weight=1, pool=20, top=10, per=2)} {_OUT} cand")
def bm25_topk(spark, d):
    return shown(pool(spark, d, one_question(spark, d), RankingOptions(keyword_weight=1, top_k=10)))


@query(f"WITH {_WHOLE}, {_BENCH}, {_POSTINGS}, {_bm25(0)} SELECT question_id, ord, round(raw, 9) AS raw FROM bm")
def bm25_content_only(spark, d):
    return retriever(spark, d).index.bm25(benchmark_questions(spark, d), 0).select("question_id", "ord", F.round("raw", 9).alias("raw"))


@query(f"WITH {_STORE}, {_ONE.format(QUESTION)}, {_search()} {_OUT} hits")
def hybrid_search(spark, d):
    return shown(hits(spark, d, one_question(spark, d)))


@query(f"WITH {_STORE}, {_ONE.format(QUESTION)}, {_search(least=0.3)} {_OUT} hits")
def hybrid_min_score(spark, d):
    return shown(hits(spark, d, one_question(spark, d), RankingOptions(min_score=0.3)))


@query(f"WITH {_STORE}, {_ONE.format('zzzz qqqq 日本')}, {_search()} {_OUT} hits")
def hybrid_no_keyword(spark, d):
    return shown(hits(spark, d, one_question(spark, d, "zzzz qqqq 日本")))


@query(f"WITH {_STORE}, {_BENCH}, {_search()} {_OUT} cand")
def batch_candidates(spark, d):
    return shown(pool(spark, d, benchmark_questions(spark, d)))


@query(f"WITH {_STORE}, {_BENCH}, {_search()} {_OUT} hits")
def batch_questions_search(spark, d):
    return shown(hits(spark, d, benchmark_questions(spark, d)))


@query("WITH r AS (SELECT 0::BIGINT AS question_id, doc_id, source, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents), c AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rank) AS n FROM r) SELECT question_id, doc_id, source, row_number() OVER (ORDER BY rank)::INTEGER AS rank FROM c WHERE n <= 3")
def diverse_hits(spark, d):
    # Any ordered value serves as rank, so no global numbering is needed: each source keeps its three first.
    ranked = read(spark, d, "documents").select(F.lit(0).cast("bigint").alias("question_id"), "doc_id", "source", F.struct(-F.col("n_chars"), "doc_id").alias("rank"))
    return select_diverse(ranked, 3)


_BLOCK = "'---' || chr(10) || '[' || rank || '] source=' || source || chr(10) || 'heading=' || heading || chr(10) || content || chr(10) || '---'"
_CONTEXT = f"ctx AS (SELECT question_id, string_agg({_BLOCK}, chr(10) || chr(10) ORDER BY rank) AS context FROM hits GROUP BY question_id)"


@query(f"WITH {_STORE}, {_BENCH}, {_search()}, {_CONTEXT} SELECT question_id, context FROM ctx")
def context_blocks(spark, d):
    return prompts.build_context(hits(spark, d, benchmark_questions(spark, d)))


@query(f"WITH {_STORE}, {_BENCH}, {_search()}, {_CONTEXT} SELECT question_id, '{PROMPT.system}' AS system, '参考内容：' || chr(10) || context || chr(10) || chr(10) || '问题：' || chr(10) || question AS user_content FROM ctx JOIN q USING (question_id)")
def prompt_messages(spark, d):
    questions = benchmark_questions(spark, d)
    rows = prompts.build_context(hits(spark, d, questions)).join(questions, "question_id")
    m = prompts.build_messages(F.col("context"), F.col("question"), PROMPT)
    return rows.select("question_id", m[0]["content"].alias("system"), m[1]["content"].alias("user_content"))


@query(
    f"WITH {_STORE}, {_BENCH}, {_search(least=0.72)}, {_CONTEXT} SELECT q.question_id, CASE WHEN context IS NULL THEN '我不知道' ELSE 'seen ' || length('参考内容：' || chr(10) || context || chr(10) || chr(10) || '问题：' || chr(10) || question) END AS answer, CASE WHEN context IS NULL THEN 'no-hits' END AS no_answer_reason FROM q LEFT JOIN ctx USING (question_id)"
)
def answers(spark, d):
    questions = benchmark_questions(spark, d)
    found = hits(spark, d, questions, RankingOptions(min_score=0.72))
    return prompts.answer(questions, found, lambda m: f"seen {len(m[1]['content'])}", PROMPT).select("question_id", "answer", "no_answer_reason")


@query(f"WITH {_STORE}, {_ONE.format(QUESTION)}, {_search()} SELECT question_id, rank::INTEGER AS rank, lpad(rank::VARCHAR, 2, ' ') || '  ' || printf('%.4f', score) || '  ' || rpad(id, max(length(id)) OVER ()::INTEGER, ' ') || '  ' || replace(CASE WHEN length(content) > 40 THEN substring(content, 1, 37) || '...' ELSE content END, chr(10), ' ') AS line FROM hits")
def hit_lines(spark, d):
    return prompts.hit_table(hits(spark, d, one_question(spark, d)))


@query()
def ingest_fingerprint(spark, d):
    options = IngestOptions()
    return C.fingerprint(C.build_chunks(documents(spark, d), options), options, "lmstudio", "test-embedding")


@query("SELECT doc_id, source FROM documents WHERE source NOT IN ('src0', 'src3')")
def exclude_sources(spark, d):
    from strandix.sources import documents as D

    return D.excluded(read(spark, d, "documents").select("doc_id", "source"), ["src0", "src3"])


@query(f"WITH v AS (SELECT DISTINCT unnest({_TOKENS.format('text')}) AS term FROM documents), t AS (SELECT item_id, unnest({_TOKENS.format('text')}) AS term FROM benchmark) SELECT item_id AS question_id, count(DISTINCT t.term) AS n_terms, count(DISTINCT v.term) AS n_known FROM t LEFT JOIN v ON t.term = v.term GROUP BY 1")
def vocabulary_gate(spark, d):
    questions = read(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    return keywords.known_terms(questions, keywords.doc_freq(keywords.postings(whole(spark, d))).where("df_content > 0"))


@query(f"WITH {_WHOLE}, k AS (SELECT sha1(text) AS h FROM documents JOIN embeddings ON vec_id = doc_id) SELECT count(*) AS records, count(*) FILTER (sha1(content) IN (SELECT h FROM k)) AS cached, count(*) FILTER (sha1(content) NOT IN (SELECT h FROM k)) AS embedded FROM chunk")
def row_counters(spark, d):
    from strandix.operators import ingest as I

    return I.counters(_hashed(spark, d), _cache(spark, d))


@query("WITH e AS (SELECT d.doc_id, d.source FROM documents d), r AS (SELECT b.label AS question_id, row_number() OVER (PARTITION BY b.label ORDER BY b.vec_id) AS rank, e.source FROM embeddings b JOIN e ON e.doc_id = b.vec_id), h AS (SELECT question_id, source, min(rank) AS rank FROM r WHERE rank <= 10 GROUP BY ALL), x AS (SELECT DISTINCT question_id, source FROM r) SELECT x.question_id, count(*) AS n_expected, count(rank) AS n_found, count(rank)::DOUBLE / count(*) AS recall, coalesce(1.0::DOUBLE / min(rank), 0) AS reciprocal_rank FROM x LEFT JOIN h USING (question_id, source) GROUP BY 1")
def retrieval_eval(spark, d):
    from pyspark.sql.window import Window

    rows = read(spark, d, "embeddings").join(read(spark, d, "documents"), F.col("vec_id") == F.col("doc_id")).select(F.col("label").alias("question_id"), F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).alias("rank"), "source")
    return evaluate.recall(rows.where("rank <= 10"), rows.select("question_id", "source"))


@query("SELECT doc_id AS ord, source || '#' || doc_id AS id, source, lang AS heading, text AS content, round(embedding[1]::DOUBLE, 6) AS first, 64 AS dim FROM documents JOIN embeddings ON vec_id = doc_id % (SELECT count(*) FROM embeddings)")
def store_round_trip(spark, d):
    """The store as newline-delimited JSON and back."""
    from strandix.sources import store as S

    rows = C.with_keyword_stats(store(spark, d)).withColumn("hash", F.sha1(F.encode("content", "UTF-8")))
    lines = S.record_lines(rows)
    back, _ = S.parse_records(lines, 64)
    return back.select("ord", "id", "source", "heading", "content", F.round(F.get("embedding", F.lit(0)).cast("float").cast("double"), 6).alias("first"), F.size("embedding").alias("dim"))


@query("SELECT doc_id AS ord, CASE doc_id % 5 WHEN 0 THEN 'unparseable' WHEN 1 THEN 'embedding' WHEN 2 THEN 'embedding' ELSE 'incomplete' END AS reason, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 4 THEN 'unknown' ELSE 'd' || doc_id END AS id FROM documents")
def store_rejects(spark, d):
    from strandix.sources import store as S

    i = F.col("doc_id").cast("string")
    line = (
        F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("{bad json "), i))
        .when(F.col("doc_id") % 5 == 1, F.concat(F.lit('{"id":"d'), i, F.lit('","embedding":[1,2,3]}')))
        .when(F.col("doc_id") % 5 == 2, F.concat(F.lit('{"id":"d'), i, F.lit('","embedding":[1,null],"source":"s","chunkIndex":0,"content":"c"}')))
        .when(F.col("doc_id") % 5 == 3, F.concat(F.lit('{"id":"d'), i, F.lit('","embedding":[1,0.5],"source":"s","chunkIndex":0}')))
        .otherwise(F.lit('{"embedding":[1,0.5],"source":"s","chunkIndex":"0","content":"c"}'))
    )
    return S.parse_records(read(spark, d, "documents").select(F.col("doc_id").alias("ord"), line.alias("value")), 2)[1]


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '../' || source || '/' || doc_id || '.MD' ELSE source || '/.md' || doc_id || '.txt' END AS path, CASE WHEN doc_id % 3 = 0 THEN '.md' ELSE '.txt' END AS ext FROM documents")
def portable_paths(spark, d):
    from strandix.sources import documents as D

    i = F.col("doc_id").cast("string")
    path = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("/data/"), "source", F.lit("/"), i, F.lit(".MD"))).otherwise(F.concat(F.lit("/data/root/"), "source", F.lit("/.md"), i, F.lit(".txt")))
    return read(spark, d, "documents").select("doc_id", D.portable(path, "/data/root").alias("path"), D.extension(path).alias("ext"))


@query(f"WITH {_CHUNKS}, n AS (SELECT source, i::INTEGER AS chunk_index, sha1(content) AS hash FROM ch) SELECT * FROM n")
def stream_ingest(spark, d):
    """All documents as a file stream, ingested batch by batch until none are left."""
    import os

    from strandix.streaming import flows

    path = shared_path(spark, "stream")
    schema = read(spark, d, "documents").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "documents.parquet" if os.path.isfile(f"{d}/documents.parquet") else "*.parquet").option("maxFilesPerTrigger", 4).parquet(d if os.path.isfile(f"{d}/documents.parquet") else f"{d}/documents.parquet")
    rows = source.select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("source"), F.col("text").alias("content"), F.col("doc_id").alias("doc_ord"))
    flows.ingest_stream(rows, f"{path}/chunks", f"{path}/checkpoint").awaitTermination()
    return flows.current(spark.read.parquet(f"{path}/chunks")).select("source", "chunk_index", "hash")

