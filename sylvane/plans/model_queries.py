"""Queries with models (their stand-ins), tree building and inference."""

from __future__ import annotations

from pyspark.sql import functions as F

from sylvane.functions import text as T
from sylvane.functions import vectors as V
from sylvane.operators import baselines, build, infer, metrics, nli, pairs, reports, search
from sylvane.operators.models import HashingEmbedder, LexicalEntailment, embed_documents
from sylvane.operators.sampling import SamplingConfig, stratified_split
from sylvane.plans.text_queries import chunks_sql, read
from sylvane.plans.vector_queries import rounded

HYPOTHESES = ("All rights are reserved", "Released under the MIT license", "The version of the license")
NEGATED = ("This text states a license", "This text states no license at all")
PROBLEMS = {"license": "licensed under a license version", "rights": "all rights reserved", "pathetic": "pathetic stupid worthless"}
DEPTHS = {"reflection": "rights are reserved", "solution": "version of the license"}
QUESTIONS = (("", "All rights reserved"), ("L", "license version apache"), ("R", "token password secret"))
TREE = (("", None, 4), ("L", None, 2), ("R", None, 2), ("LL", None, 1), ("LR", None, 1), ("RL", None, 1), ("RR", None, 1))
TOPICS = (("", "Is this about science and nature?"), ("L", "Is it about the nature of cells?"), ("R", "Is it about old science books?"), ("LL", ""), ("LR", None), ("RL", None), ("RR", "Are these books about cells?"))


def documents(spark, sf_dir):
    return read(spark, sf_dir, "documents")


def logits(spark, sf_dir, asked=HYPOTHESES):
    table = spark.createDataFrame([(h,) for h in asked], "hypothesis string")
    return nli.pooled_logits(documents(spark, sf_dir), table, LexicalEntailment())


def nli_scores(spark, sf_dir):
    made = nli.nli_results(logits(spark, sf_dir))
    return rounded(made, *[c for c, t in made.dtypes if t == "double"])


def nli_logits(spark, sf_dir):
    return rounded(nli.nli_logits(logits(spark, sf_dir)), "e_logit", "c_logit", "p_entailment")


def zero_shot_negated(spark, sf_dir):
    return nli.zero_shot(logits(spark, sf_dir, NEGATED), *NEGATED)


def entailment_search(spark, sf_dir):
    return search.hypotheses(documents(spark, sf_dir), HYPOTHESES, LexicalEntailment()).select(F.col("id").alias("doc_id"), "input", "found")


def logical_pairs(spark, sf_dir):
    return rounded(nli.logical_pairs(read(spark, sf_dir, "benchmark"), LexicalEntailment(), "item_id"), "sim")


def logical_by_category(spark, sf_dir):
    """Logical similarity of the turns of each conversation, in the report of all components."""
    turns = read(spark, sf_dir, "conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text", "conv_id")
    made = pairs.similarity_report(turns, "id", "text", categories=["conv_id"], n=1, scorer=LexicalEntailment())
    number = lambda c, d: F.when(~F.isnan(c), F.round(c, d))
    return made.select("category", "n", number("logical.mean", 6).alias("mean"), number("logical.std", 5).alias("std"))


def functional_similarity(spark, sf_dir):
    scores = nli.nli_results(logits(spark, sf_dir)).select("hypothesis", F.col("doc_id").alias("premise"), F.col("entailment_score").alias("p"))
    return rounded(nli.functional_pairs(scores), "sim")


def issue_findings(spark, sf_dir):
    pages = documents(spark, sf_dir).select(F.col("doc_id").alias("page"), "text")
    return search.issues(pages, PROBLEMS, DEPTHS, LexicalEntailment())[0]


def issue_depths(spark, sf_dir):
    pages = documents(spark, sf_dir).select(F.col("doc_id").alias("page"), "text")
    return search.issues(pages, PROBLEMS, DEPTHS, LexicalEntailment())[1]


def question_tree(spark):
    nodes = spark.createDataFrame([(n, len(n), c == 1) for n, _, c in TREE], "node_id string, depth int, is_leaf boolean")
    return nodes.join(spark.createDataFrame(list(QUESTIONS), "node_id string, question string"), "node_id", "left")


def tree_inference(spark, sf_dir):
    made = infer.walk(documents(spark, sf_dir), question_tree(spark), LexicalEntailment())
    return made.select("doc_id", "node_id", F.array_join(F.transform("path", lambda p: p["decision"]), ">").alias("decisions"))


def path_texts(spark, sf_dir):
    made = infer.walk(documents(spark, sf_dir), question_tree(spark), LexicalEntailment())
    back = T.maps_path(T.path_maps(F.col("path")))
    return made.select("doc_id", T.path_text(F.col("path")).alias("path_text"), T.equal_levels(F.col("path"), back).alias("levels"))


def random_paths(spark, sf_dir):
    n = documents(spark, sf_dir).count()
    return infer.random_paths(question_tree(spark), n, 42).select("path_no", "node_id")


def path_levels(spark, sf_dir):
    """Levels that each random path shares with the next one, every second of which is cut after a level."""
    paths = infer.random_paths(question_tree(spark), documents(spark, sf_dir).count(), 42)
    after = paths.select((F.col("path_no") - 1).alias("path_no"), F.slice("path", F.lit(1), (1 + F.col("path_no") % 2).cast("int")).alias("other"))
    return paths.join(after, "path_no").select("path_no", T.equal_levels(F.col("path"), F.col("other")).alias("levels"))


def topic_nodes(spark):
    return spark.createDataFrame([(n, q, len(n) == 2) for n, q in TOPICS], "node_id string, question string, is_leaf boolean")


def topic_diversity_full(spark, sf_dir):
    return rounded(metrics.topic_diversity(topic_nodes(spark)), "topic_diversity")


def topic_diversity_paths(spark, sf_dir):
    return rounded(metrics.topic_diversity(topic_nodes(spark), "leaf_paths"), "topic_diversity")


def labelled(spark, sf_dir):
    return documents(spark, sf_dir).join(read(spark, sf_dir, "labels"), "doc_id")


def judge_averages(spark, sf_dir):
    return rounded(reports.judge_averages(labelled(spark, sf_dir), ["lang"], ["quality", "toxic"]), "quality", "toxic")


def inference_report(spark, sf_dir):
    rows = labelled(spark, sf_dir).select("doc_id", F.col("quality").alias("label"), F.col("toxic").alias("predicted"))
    made = reports.inference_report(rows)
    return rounded(made, *made.columns)


def generation_fidelity(spark, sf_dir):
    runs = read(spark, sf_dir, "conversations").select((F.length("text") % 2 == 0).alias("equal"), (F.length("text") % 6).alias("levels"), F.lit(5).alias("n_levels"))
    made = reports.fidelity(runs)
    return rounded(made, *made.columns)


def best_method(spark, sf_dir):
    rows = spark.createDataFrame([("rtp", 1, 0.8, 0.4), ("hdbscan", 2, 0.8, 0.3), ("bertopic", 3, 0.7, 0.3)], "method string, priority int, purity double, entropy double")
    return reports.best_of(rows)


def hashed_embeddings(spark, sf_dir):
    made = embed_documents(documents(spark, sf_dir), HashingEmbedder(64))
    return made.select("doc_id", F.size("embedding").alias("d"), F.round(V.norm(F.col("embedding")), 6).alias("norm"))


def topic_tree_build(spark, sf_dir):
    docs = documents(spark, sf_dir)
    config = build.TreeConfig(max_depth=3, min_node_size=20, max_retries=1, select=SamplingConfig("random", 14), n_scored=0.3)
    nodes, _ = build.build_tree(docs, embed_documents(docs, HashingEmbedder(64)), config)
    return nodes.select("node_id", "question", "n_docs", "is_leaf")


def kmeans_tree_build(spark, sf_dir):
    docs = documents(spark, sf_dir)
    config = build.TreeConfig(max_depth=2, min_node_size=20, max_retries=1, split="kmeans", nli_overrides_kmeans=False, n_scored=0.3)
    nodes, _ = build.build_tree(docs, embed_documents(docs, HashingEmbedder(64)), config)
    return nodes.select("node_id", "question", "n_docs", "is_leaf")


def split(rows, id_col):
    parts = stratified_split(rows, "label", id_col=id_col)
    return parts.where("is_train").drop("is_train"), parts.where("not is_train").drop("is_train")


def bow_decision_tree(spark, sf_dir):
    """Learned from four fifths of each label, applied to the rest."""
    rows = labelled(spark, sf_dir).select("doc_id", "text", F.col("quality").cast("double").alias("label"))
    return baselines.word_tree(*split(rows, "doc_id"), least=5).select("doc_id", "label", "predicted", "leaf")


def sampled_tree(spark, sf_dir, strategy):
    docs = documents(spark, sf_dir)
    config = build.TreeConfig(max_depth=1, min_node_size=20, max_retries=0, select=SamplingConfig(strategy, 9), n_scored=0.3)
    nodes, _ = build.build_tree(docs, embed_documents(docs, HashingEmbedder(64)), config)
    return nodes.select("node_id", "question", "n_docs", "is_leaf")


def votek_tree_build(spark, sf_dir):
    return sampled_tree(spark, sf_dir, "vote_k")


def kmeans_sampled_tree_build(spark, sf_dir):
    return sampled_tree(spark, sf_dir, "kmeans")


def vector_decision_tree(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").withColumn("label", F.col("label").cast("double"))
    return baselines.vector_tree(*split(rows, "vec_id"), least=5).select("vec_id", "label", "predicted", "leaf")


def density_clusters(spark, sf_dir):
    return baselines.density_clusters(read(spark, sf_dir, "embeddings"), 5, 1, "vec_id").groupBy("cluster").agg(F.count("*").alias("n"))


def topic_words(spark, sf_dir):
    docs = documents(spark, sf_dir)
    topics = baselines.bisecting_topics(embed_documents(docs, HashingEmbedder(64)), 4)
    return baselines.topic_words(docs, topics, 8)


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_STOP = _quoted(T.STOP_WORDS)
_TOKENS = f"list_filter(list_distinct(regexp_extract_all(lower({{0}}), '[a-z0-9]+')), lambda x: x NOT IN ({_STOP}))"


def _logits_sql(hypotheses) -> str:
    return f"""WITH {chunks_sql(350, 50, 2000)}, h AS (SELECT unnest([{_quoted(hypotheses)}]) AS hypothesis), hw AS (SELECT hypothesis, {_TOKENS.format('hypothesis')} AS hw FROM h), cw AS (SELECT doc_id, {_TOKENS.format('chunk')} AS cw FROM chunks),
      r AS (SELECT doc_id, hypothesis, CASE WHEN len(hw) = 0 THEN 0 ELSE len(list_intersect(hw, cw)) / len(hw)::DOUBLE END AS r FROM cw, hw),
      l AS MATERIALIZED (SELECT doc_id, hypothesis, max(4 * r - 2) AS e, max(2 - 4 * r) AS c, 0.0::DOUBLE AS n FROM r GROUP BY ALL),
      s AS MATERIALIZED (SELECT doc_id, hypothesis, e, c, exp(e) / (exp(e) + exp(c)) AS pb, exp(c) / (exp(e) + exp(c)) AS cb, exp(e) / (exp(e) + exp(c) + exp(n)) AS p3, exp(c) / (exp(e) + exp(c) + exp(n)) AS c3, exp(n) / (exp(e) + exp(c) + exp(n)) AS n3 FROM l)"""


def _h(*p: str) -> str:
    return " + ".join(f"-{x} * log2({x} + 1e-10)" for x in p)


_JS = lambda p, q: f"(1 - ((CASE WHEN {p} <= 0 THEN 0 ELSE {p} * log2({p} / (({p} + {q}) / 2)) END + CASE WHEN 1 - {p} <= 0 THEN 0 ELSE (1 - {p}) * log2((1 - {p}) / (1 - ({p} + {q}) / 2)) END) + (CASE WHEN {q} <= 0 THEN 0 ELSE {q} * log2({q} / (({p} + {q}) / 2)) END + CASE WHEN 1 - {q} <= 0 THEN 0 ELSE (1 - {q}) * log2((1 - {q}) / (1 - ({p} + {q}) / 2)) END)) / 2)"
_WALK = f"""{_logits_sql([q for _, q in QUESTIONS])}, q AS (SELECT * FROM (VALUES {', '.join(f"('{n}', '{q}')" for n, q in QUESTIONS)}) t(node_id, question)),
  one AS (SELECT doc_id, CASE WHEN e > c THEN 'L' ELSE 'R' END AS node_id FROM l WHERE hypothesis = (SELECT question FROM q WHERE node_id = '')),
  two AS MATERIALIZED (SELECT o.doc_id, o.node_id AS first, o.node_id || CASE WHEN e > c THEN 'L' ELSE 'R' END AS node_id FROM one o JOIN q ON q.node_id = o.node_id JOIN l ON l.doc_id = o.doc_id AND l.hypothesis = q.question)"""
_YES = "CASE WHEN {0} = 'L' THEN 'yes' ELSE 'no' END"
_TOP = rf"list_filter(regexp_extract_all(lower(question), '\b\w+\b'), lambda x: x NOT IN ({_STOP}) AND length(x) >= 3)[1:10]"
_TOPIC = f"n AS (SELECT * FROM (VALUES {', '.join('(' + repr(n) + ', ' + ('NULL' if q is None else repr(q)) + ')' for n, q in TOPICS)}) t(node_id, question)), w AS (SELECT node_id, unnest({_TOP}) AS w FROM n WHERE question <> '')"
_LABELLED = "documents JOIN labels USING (doc_id)"

QUERIES = {
    f.__name__: f
    for f in (
        nli_scores, nli_logits, zero_shot_negated, entailment_search, logical_pairs, logical_by_category, functional_similarity, issue_findings, issue_depths, tree_inference, path_texts,
        random_paths, path_levels, topic_diversity_full, topic_diversity_paths, judge_averages, inference_report, generation_fidelity, best_method, hashed_embeddings,
        topic_tree_build, kmeans_tree_build, votek_tree_build, kmeans_sampled_tree_build, bow_decision_tree, vector_decision_tree, density_clusters, topic_words,
    )
}

ORACLES = {
    "nli_scores": f"""{_logits_sql(HYPOTHESES)} SELECT doc_id, hypothesis, round(pb, 6) AS p_entailment_binary, round(cb, 6) AS p_contradiction_binary, round(p3, 6) AS entailment_score, round(c3, 6) AS contradiction_score, round(n3, 6) AS neutral_score,
      round({_h('pb', 'cb')}, 6) AS entropy_binary, round({_h('p3', 'c3', 'n3')}, 6) AS entropy_ternary, pb > cb AS is_entailed FROM s""",
    "nli_logits": f"{_logits_sql(HYPOTHESES)} SELECT doc_id, hypothesis, e > c AS is_entailed, round(e, 6) AS e_logit, round(c, 6) AS c_logit, round(pb, 6) AS p_entailment FROM s",
    "zero_shot_negated": f"{_logits_sql(NEGATED)} SELECT a.doc_id, a.pb > b.pb AS entailed FROM s a JOIN s b USING (doc_id) WHERE a.hypothesis = '{NEGATED[0]}' AND b.hypothesis = '{NEGATED[1]}'",
    "entailment_search": f"{_logits_sql(HYPOTHESES)} SELECT doc_id, hypothesis AS input, e > c AS found FROM s",
    "logical_pairs": f"""WITH w AS (SELECT item_id AS id, text, {_TOKENS.format('text')} AS w FROM benchmark),
      r AS (SELECT a.id AS i, b.id AS j, length(a.text) < 3 OR length(b.text) < 3 AS short, CASE WHEN len(b.w) = 0 THEN 0 ELSE len(list_intersect(a.w, b.w)) / len(b.w)::DOUBLE END AS f, CASE WHEN len(a.w) = 0 THEN 0 ELSE len(list_intersect(a.w, b.w)) / len(a.w)::DOUBLE END AS g FROM w a JOIN w b ON a.id < b.id)
      SELECT i, j, round(CASE WHEN short THEN 0 ELSE sqrt(exp(4 * f - 2) / (exp(4 * f - 2) + exp(2 - 4 * f) + 1) * exp(4 * g - 2) / (exp(4 * g - 2) + exp(2 - 4 * g) + 1)) END, 6) AS sim FROM r""",
    "logical_by_category": f"""WITH w AS (SELECT conv_id, conv_id || ':' || turn AS id, text, {_TOKENS.format('text')} AS w FROM conversations WHERE text IS NOT NULL AND conv_id IS NOT NULL),
      r AS (SELECT a.conv_id, length(a.text) < 3 OR length(b.text) < 3 AS short, CASE WHEN len(b.w) = 0 THEN 0 ELSE len(list_intersect(a.w, b.w)) / len(b.w)::DOUBLE END AS f, CASE WHEN len(a.w) = 0 THEN 0 ELSE len(list_intersect(a.w, b.w)) / len(a.w)::DOUBLE END AS g FROM w a JOIN w b ON a.conv_id = b.conv_id AND a.id < b.id),
      s AS (SELECT conv_id, CASE WHEN short THEN 0 ELSE sqrt(exp(4 * f - 2) / (exp(4 * f - 2) + exp(2 - 4 * f) + 1) * exp(4 * g - 2) / (exp(4 * g - 2) + exp(2 - 4 * g) + 1)) END AS sim FROM r),
      q AS (SELECT conv_id, avg(sim) AS mean, sqrt(greatest(avg(sim * sim) - avg(sim) ** 2, 0)) AS std FROM s GROUP BY conv_id)
      SELECT CAST(c.conv_id AS VARCHAR) AS category, c.n, round(mean, 6) AS mean, round(std, 5) AS std FROM (SELECT conv_id, count(*) AS n FROM w GROUP BY conv_id) c LEFT JOIN q USING (conv_id)""",
    "path_levels": """WITH c AS (SELECT i, strpos('0123456789abcdef', left(md5('42:' || i || ':0'), 1)) % 2 AS a, strpos('0123456789abcdef', left(md5('42:' || i || ':1'), 1)) % 2 AS b FROM range((SELECT count(*) FROM documents)) t(i))
      SELECT x.i AS path_no, CASE WHEN y.i % 2 = 0 OR x.a <> y.a THEN 0 WHEN x.b = y.b THEN 2 ELSE 1 END AS levels FROM c x JOIN c y ON y.i = x.i + 1""",
    "functional_similarity": f"{_logits_sql(HYPOTHESES)} SELECT a.hypothesis AS i, b.hypothesis AS j, round(avg({_JS('a.p3', 'b.p3')}), 6) AS sim FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.hypothesis < b.hypothesis GROUP BY ALL",
    "tree_inference": f"{_WALK} SELECT doc_id, node_id, {_YES.format('first')} || '>' || {_YES.format('right(node_id, 1)')} AS decisions FROM two",
    "path_texts": f"""{_WALK} SELECT doc_id, 'Question: ' || (SELECT question FROM q WHERE q.node_id = '') || '? Answer: ' || CASE WHEN first = 'L' THEN 'Yes' ELSE 'No' END || chr(10) || 'Question: ' || q.question || '? Answer: ' || CASE WHEN right(two.node_id, 1) = 'L' THEN 'Yes' ELSE 'No' END AS path_text, 2 AS levels
      FROM two JOIN q ON q.node_id = first""",
    "random_paths": """WITH c AS (SELECT i AS path_no, strpos('0123456789abcdef', left(md5('42:' || i || ':0'), 1)) - 1 AS a, strpos('0123456789abcdef', left(md5('42:' || i || ':1'), 1)) - 1 AS b FROM range((SELECT count(*) FROM documents)) t(i))
      SELECT path_no, CASE WHEN a % 2 = 1 THEN 'L' ELSE 'R' END || CASE WHEN b % 2 = 1 THEN 'L' ELSE 'R' END AS node_id FROM c""",
    "topic_diversity_full": f"WITH {_TOPIC} SELECT round(count(DISTINCT w) / count(w)::DOUBLE, 6) AS topic_diversity FROM w",
    "topic_diversity_paths": f"WITH {_TOPIC}, p AS (SELECT l.node_id, count(DISTINCT w) / count(w)::DOUBLE AS r FROM n l JOIN w ON starts_with(l.node_id, w.node_id) WHERE length(l.node_id) = 2 GROUP BY l.node_id) SELECT round(avg(r), 6) AS topic_diversity FROM p",
    "judge_averages": f"SELECT lang, round(avg(quality), 6) AS quality, round(avg(toxic), 6) AS toxic FROM {_LABELLED} GROUP BY lang",
    "generation_fidelity": "WITH r AS (SELECT (length(text) % 2 = 0)::INT AS e, length(text) % 6 / 5.0 AS s FROM conversations) SELECT round(avg(s), 6) AS level_share, round(avg(e), 6) AS p_path, round(avg(e) ** 0.2, 6) AS p_node FROM r",
    "best_method": "SELECT 'rtp' AS best_purity, 'hdbscan' AS best_entropy",
    "inference_report": f"""WITH r AS (SELECT quality AS y, toxic AS c FROM {_LABELLED}), t AS (SELECT y, c, count(*)::DOUBLE AS n FROM r GROUP BY ALL), tot AS (SELECT sum(n) AS total FROM t),
      ty AS (SELECT y, sum(n) AS ny FROM t GROUP BY y), tc AS (SELECT c, sum(n) AS nc FROM t GROUP BY c), lb AS (SELECT y AS l FROM ty UNION SELECT c FROM tc),
      k AS (SELECT coalesce((SELECT n FROM t WHERE y = l AND c = l), 0) AS tp, coalesce((SELECT ny FROM ty WHERE y = l), 0) AS s, coalesce((SELECT nc FROM tc WHERE c = l), 0) AS m FROM lb),
      i AS (SELECT (SELECT -sum(ny / total * ln(ny / total)) FROM ty, tot) AS hy, (SELECT -sum(nc / total * ln(nc / total)) FROM tc, tot) AS hc, (SELECT sum(n / total * ln(n * total / (ny * nc))) FROM t JOIN ty USING (y) JOIN tc USING (c), tot) AS mi),
      a AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM t) AS b, (SELECT sum(ny * (ny - 1) / 2) FROM ty) AS y, (SELECT sum(nc * (nc - 1) / 2) FROM tc) AS c, (SELECT total * (total - 1) / 2 FROM tot) AS p)
      SELECT (SELECT round(avg((y = c)::INT), 6) FROM r) AS accuracy, (SELECT round(avg(CASE WHEN s + m = 0 THEN 0 ELSE 2 * tp / (s + m) END), 6) FROM k) AS f1_macro, round(mi / ((hy + hc) / 2), 6) AS nmi, (SELECT round((b - y * c / p) / ((y + c) / 2 - y * c / p), 6) FROM a) AS ari FROM i""",
}

_SENTENCES = r"string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), chr(1))"
_NAMED = lambda table: ", ".join(f"('{k}', '{v}')" for k, v in table.items())
_SHARE = "CASE WHEN len(hw) = 0 THEN 0 ELSE len(list_intersect(hw, pw)) / len(hw)::DOUBLE END"
_FINDINGS = f"""h AS (SELECT n AS problem_name, {_TOKENS.format('q')} AS hw FROM (VALUES {_NAMED(PROBLEMS)}) t(n, q)), sp AS (SELECT doc_id AS page, {_SENTENCES} AS s FROM documents),
  se AS MATERIALIZED (SELECT page, no, sentence, {_TOKENS.format('sentence')} AS pw FROM (SELECT page, unnest(range(len(s))) AS no, unnest(s) AS sentence FROM sp)),
  r AS (SELECT page, problem_name, no, sentence, {_SHARE} AS r FROM se, h), b AS (SELECT *, row_number() OVER (PARTITION BY page, problem_name ORDER BY r DESC, no) AS k FROM r),
  f AS MATERIALIZED (SELECT page, problem_name, sentence AS evidence FROM b WHERE k = 1 AND r > 0.5)"""
ORACLES["issue_findings"] = f"WITH {_FINDINGS} SELECT * FROM f"
ORACLES["issue_depths"] = f"""WITH {_FINDINGS}, dh AS (SELECT n AS depth, {_TOKENS.format('q')} AS hw FROM (VALUES {_NAMED(DEPTHS)}) t(n, q)), fp AS (SELECT *, {_TOKENS.format("problem_name || ' - ' || evidence")} AS pw FROM f)
  SELECT page, problem_name, depth, evidence FROM fp, dh WHERE {_SHARE} > 0.5"""
ORACLES["hashed_embeddings"] = f"WITH {chunks_sql(100, 25, 1000)} SELECT doc_id, 64 AS d, CAST(max(CASE WHEN trim(chunk) <> '' THEN 1 ELSE 0 END) AS DOUBLE) AS norm FROM chunks GROUP BY doc_id"
