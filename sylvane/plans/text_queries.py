"""Queries over texts: chunks, searches, pairwise lexical similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from sylvane.functions import text as T
from sylvane.operators import pairs, search
from sylvane.operators.chunking import chunk_documents
from sylvane.sources import readers

KEYWORDS = ("token", "Apache", "rights")
PATTERNS = (r"[0-9]{3}-[0-9]{4}", r"[a-z]+[.][0-9]+@[a-z0-9.]+", r"Version [0-9.]+")
RUNS = ("/runs/tree_wikipedia_gptoss20b_votek_deberta.json", "/runs/a_b_bills_gpt-4o_kmeans_base.json")


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunk_query(spark, sf_dir):
    return chunk_documents(read(spark, sf_dir, "documents"), size=100, overlap=25, max_characters=1000).select("doc_id", "chunk_no", "chunk")


def chunk_counts_by_lang(spark, sf_dir):
    made = chunk_documents(read(spark, sf_dir, "documents"), size=100, overlap=25, keep=["lang"])
    return made.groupBy("lang").agg(F.count("*").alias("n_chunks"), F.sum(F.length("chunk")).alias("n_characters"))


def normalised_text(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", T.normalise(F.col("text")).alias("t"))
    return docs.select("doc_id", F.md5("t").alias("normal_md5"), F.length("t").alias("normal_length"), F.size(T.filtered_words(F.col("t"))).alias("n_filtered_words"))


def crop_documents(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(T.crop_words(F.col("text"), 120)).alias("cropped_md5"))


def accent_repair(spark, sf_dir):
    apart = F.replace(F.replace(F.col("text"), F.lit("é"), F.lit("´e")), F.lit("ç"), F.lit("c¸"))
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(apart).alias("apart_md5"), F.md5(T.repair_accents(apart)).alias("repaired_md5"))


def keyword_search(spark, sf_dir):
    return search.keywords(read(spark, sf_dir, "documents"), KEYWORDS).select(F.col("id").alias("doc_id"), "input", "found")


def regex_search(spark, sf_dir):
    return search.patterns(read(spark, sf_dir, "documents"), PATTERNS).select(F.col("id").alias("doc_id"), "input", "found", "output")


def search_report(spark, sf_dir):
    answers = search.search(read(spark, sf_dir, "documents"), search.Recipe(KEYWORDS, PATTERNS))
    made = search.report(answers)
    return made.select(F.col("id").alias("doc_id"), F.array_join(F.transform("answers", lambda a: F.concat_ws("=", a["method"], a["input"], a["output"])), ";").alias("answers"))


def top_words(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(T.top_words(F.regexp_replace("text", r"[^\x00-\x7F]", ""), 10), " ").alias("words"))


def short_labels(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", T.short_label(F.col("text")).alias("label"))


def category_sizes(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").na.drop("any")
    return docs.groupBy(T.category(F.col("lang"), F.col("source")).alias("category")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


def page_range(spark, sf_dir):
    return search.page_range(read(spark, sf_dir, "pages"), "page_id", 10, 60).select("page_id", "url")


def without_output(spark, sf_dir):
    """Pages without a result, where every third has one."""
    files = read(spark, sf_dir, "pages").select(F.col("url").alias("path"), "page_id")
    made = files.where("page_id % 3 = 0").select(F.concat(F.regexp_replace("path", r"\.[^./]*$", ""), F.lit(".csv")).alias("path"))
    return readers.without_output(files, made)


def file_limit(spark, sf_dir):
    files = read(spark, sf_dir, "pages").select(F.col("url").alias("path"), "page_id")
    return readers.first_files(files, 25)


def run_names(spark, sf_dir):
    names = spark.createDataFrame([(r,) for r in RUNS], "path string")
    return names.select("path", T.run_parameters(F.col("path")).alias("r"), T.first_contained(F.col("path"), (("wikipedia", "wiki"), ("bills", "bills"))).alias("family")).select("path", "r.*", "family")


def question_turns(spark, sf_dir):
    from sylvane.operators.models import QuestionMark

    return read(spark, sf_dir, "conversations").select("conv_id", "turn", QuestionMark().is_question(F.col("text")).alias("is_question"))


def ngram_sets(spark, sf_dir):
    items = read(spark, sf_dir, "benchmark").select("item_id", T.ngrams_up_to(T.words(F.col("text")), 3).alias("g"))
    return items.select("item_id", F.size("g").alias("n_grams"), F.md5(F.array_join(F.array_sort("g"), "|")).alias("grams_md5"))


def pairwise_jaccard(spark, sf_dir):
    return pairs.jaccard_pairs(read(spark, sf_dir, "benchmark"), "item_id", "text", 3).select("i", "j", F.round("sim", 6).alias("sim"))


def lexical_pooled(spark, sf_dir):
    made = pairs.lexical_similarity(read(spark, sf_dir, "benchmark"), "item_id", "text", 3)
    return made.select("n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def similarity_by_category(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").select(F.monotonically_increasing_id().alias("x"), F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text", F.floor(F.col("conv_id") / 10).alias("block"))
    made = pairs.similarity_report(turns.select("id", "text", "block"), "id", "text", categories=["block"], n=2)
    ok = F.when(F.isnan("lexical.mean"), F.lit(None)).otherwise(F.round("lexical.mean", 6))
    dev = F.when(F.isnan("lexical.std"), F.lit(None)).otherwise(F.round("lexical.std", 5))
    return made.select("category", "n", ok.alias("mean"), dev.alias("std"))


NORMAL = r"""regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(coalesce(text, ''), '[^\x20-\x7E\n\t]', '', 'g'), '[ \n\t]+', ' ', 'g')), '\S{15,}', '', 'g'), '--+', '', 'g'), 'cut\s+here[.]+end\s+cut\s+here', '', 'g')"""
WORDS = "list_filter(string_split(t, ' '), lambda x: regexp_full_match(x, '[a-zA-Z0-9]+') AND length(x) < 10)"
PLAIN_WORDS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda x: x <> '')"


def chunks_sql(size: int, overlap: int, most: int, keep: str = "doc_id") -> str:
    step = size - overlap
    return f"""n AS (SELECT *, {NORMAL} AS t FROM documents), w AS (SELECT *, {WORDS} AS w FROM n),
      c AS (SELECT *, CASE WHEN len(w) <= {size} THEN [substring(t, 1, {most})] ELSE list_transform(range(0, CAST(ceil((len(w) - {size}) / {step}.0) AS BIGINT) + 1),
        lambda i: substring(array_to_string(w[i * {step} + 1 : i * {step} + {size}], ' '), 1, {most})) END AS cs FROM w),
      chunks AS (SELECT {keep}, CAST(i AS INTEGER) AS chunk_no, cs[i + 1] AS chunk FROM (SELECT *, unnest(range(len(cs))) AS i FROM c))"""


def _grams(n: int, words: str) -> str:
    parts = ", ".join(f"list_transform(range(0, greatest(len({words}) - {k - 1}, 0)), lambda i: array_to_string({words}[i + 1 : i + {k}], ' '))" for k in range(1, n + 1))
    return f"list_distinct(flatten([{parts}]))"


def _list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_STOP = _list(T.STOP_WORDS)
_ACCENTS = "a"
for _apart, _whole in T.ACCENTS:
    _ACCENTS = f"replace({_ACCENTS}, '{_apart}', '{_whole}')"
_KEY = f"SELECT doc_id, input, contains(coalesce(text, ''), input) AS found FROM documents, (SELECT unnest([{_list(KEYWORDS)}]) AS input)"
_REGEX = f"""SELECT doc_id, input, regexp_matches(text, input) AS found, CASE WHEN regexp_matches(text, input) THEN regexp_extract(text, input, 0) ELSE 'false' END AS output
  FROM documents, (SELECT unnest([{_list(PATTERNS)}]) AS input)"""


def _jaccard_sql(source: str, n: int, by: str = "1") -> str:
    return f"""g AS (SELECT id, {by} AS grp, {_grams(n, "w")} AS g FROM (SELECT *, {PLAIN_WORDS.format("text")} AS w FROM {source})),
      u AS (SELECT id, grp, len(g) AS n, unnest(g) AS x FROM g),
      p AS (SELECT a.grp, a.id AS i, b.id AS j, count(*) / (any_value(a.n) + any_value(b.n) - count(*))::DOUBLE AS sim FROM u a JOIN u b ON a.x = b.x AND a.grp = b.grp AND a.id < b.id GROUP BY ALL)"""


QUERIES = {
    "chunk_documents": chunk_query,
    "chunk_counts_by_lang": chunk_counts_by_lang,
    "normalised_text": normalised_text,
    "crop_documents": crop_documents,
    "accent_repair": accent_repair,
    "keyword_search": keyword_search,
    "regex_search": regex_search,
    "search_report": search_report,
    "top_words": top_words,
    "short_labels": short_labels,
    "category_sizes": category_sizes,
    "page_range": page_range,
    "without_output": without_output,
    "file_limit": file_limit,
    "run_names": run_names,
    "question_turns": question_turns,
    "ngram_sets": ngram_sets,
    "pairwise_jaccard": pairwise_jaccard,
    "lexical_pooled": lexical_pooled,
    "similarity_by_category": similarity_by_category,
}

ORACLES = {
    "chunk_documents": f"WITH {chunks_sql(100, 25, 1000)} SELECT * FROM chunks",
    "chunk_counts_by_lang": f"WITH {chunks_sql(100, 25, 1000, 'lang')} SELECT lang, count(*) AS n_chunks, CAST(sum(length(chunk)) AS BIGINT) AS n_characters FROM chunks GROUP BY lang",
    "normalised_text": f"WITH n AS (SELECT doc_id, {NORMAL} AS t FROM documents) SELECT doc_id, md5(t) AS normal_md5, CAST(length(t) AS INTEGER) AS normal_length, CAST(len({WORDS}) AS INTEGER) AS n_filtered_words FROM n",
    "crop_documents": f"WITH w AS (SELECT doc_id, text, {PLAIN_WORDS.format('text')} AS w FROM documents) SELECT doc_id, md5(CASE WHEN len(w) <= 120 THEN text ELSE array_to_string(w[1:120], ' ') END) AS cropped_md5 FROM w",
    "accent_repair": f"WITH a AS (SELECT doc_id, replace(replace(text, 'é', '´e'), 'ç', 'c¸') AS a FROM documents) SELECT doc_id, md5(a) AS apart_md5, md5({_ACCENTS}) AS repaired_md5 FROM a",
    "keyword_search": _KEY,
    "regex_search": _REGEX,
    "search_report": f"""WITH a AS (SELECT doc_id, 'keyword' AS method, input, CASE WHEN found THEN 'true' ELSE 'false' END AS output FROM ({_KEY}) UNION ALL SELECT doc_id, 'regex', input, output FROM ({_REGEX}))
      SELECT doc_id, string_agg(method || '=' || input || '=' || output, ';' ORDER BY method, input, output) AS answers FROM a GROUP BY doc_id""",
    "top_words": rf"""SELECT conv_id, turn, array_to_string(list_filter(regexp_extract_all(lower(regexp_replace(text, '[^\x00-\x7F]', '', 'g')), '\b\w+\b'), lambda x: x NOT IN ({_STOP}) AND length(x) >= 3)[1:10], ' ') AS words FROM conversations""",
    "short_labels": "SELECT conv_id, turn, CASE WHEN length(text) > 60 THEN substring(text, 1, 57) || '...' ELSE text END AS label FROM conversations",
    "category_sizes": "SELECT lang || '_' || source AS category, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL AND n_chars IS NOT NULL GROUP BY 1",
    "without_output": r"WITH f AS (SELECT url AS path, page_id, regexp_replace(url, '\.[^./]*$', '') AS stem FROM pages) SELECT path, page_id FROM f WHERE stem NOT IN (SELECT stem FROM f WHERE page_id % 3 = 0 AND stem IS NOT NULL) OR stem IS NULL",
    "page_range": "SELECT page_id, url FROM pages WHERE page_id >= 10 AND page_id < 60",
    "file_limit": "SELECT url AS path, page_id FROM pages ORDER BY url LIMIT 25",
    "run_names": f"""WITH r AS (SELECT unnest([{_list(RUNS)}]) AS path), s AS (SELECT path, string_split(regexp_replace(string_split(path, '/')[-1], '\\.json$', ''), '_') AS p FROM r)
      SELECT path, p[-4] AS dataset, p[-3] AS llm, p[-2] AS selection, p[-1] AS nli, CASE WHEN contains(path, 'wikipedia') THEN 'wiki' WHEN contains(path, 'bills') THEN 'bills' ELSE 'unknown' END AS family FROM s""",
    "question_turns": "SELECT conv_id, turn, ends_with(rtrim(text), '?') AS is_question FROM conversations",
    "ngram_sets": f"WITH g AS (SELECT item_id, {_grams(3, 'w')} AS g FROM (SELECT item_id, {PLAIN_WORDS.format('text')} AS w FROM benchmark)) SELECT item_id, CAST(len(g) AS INTEGER) AS n_grams, md5(array_to_string(list_sort(g), '|')) AS grams_md5 FROM g",
    "pairwise_jaccard": f"WITH s AS (SELECT item_id AS id, text FROM benchmark), {_jaccard_sql('s', 3)} SELECT i, j, round(sim, 6) AS sim FROM p",
    "lexical_pooled": f"""WITH s AS (SELECT item_id AS id, text FROM benchmark), {_jaccard_sql('s', 3)}, c AS (SELECT count(*) AS n FROM benchmark),
      q AS (SELECT coalesce(sum(sim), 0) AS s, coalesce(sum(sim * sim), 0) AS q FROM p)
      SELECT n, round(s / (n * (n - 1) / 2.0), 6) AS mean, round(sqrt(q / (n * (n - 1) / 2.0) - (s / (n * (n - 1) / 2.0)) ** 2), 6) AS std FROM c, q""",
    "similarity_by_category": f"""WITH s AS (SELECT conv_id || ':' || turn AS id, text, CAST(conv_id // 10 AS VARCHAR) AS block FROM conversations), {_jaccard_sql('s', 2, 'block')},
      c AS (SELECT block, count(*) AS n FROM s GROUP BY block), q AS (SELECT grp, sum(sim) AS s, sum(sim * sim) AS q FROM p GROUP BY grp), z AS (SELECT block, n, n * (n - 1) / 2.0 AS m, coalesce(s, 0) AS s, coalesce(q, 0) AS q FROM c LEFT JOIN q ON block = grp)
      SELECT block AS category, n, CASE WHEN m > 0 THEN round(s / m, 6) END AS mean, CASE WHEN m > 0 THEN round(sqrt(greatest(q / m - (s / m) ** 2, 0)), 5) END AS std FROM z""",
}
