"""Registered queries over the driver's tables, each with the same result in DuckDB's SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as text_functions
from .functions import vectors
from .operators import assemble, blocklist, evals, joins, keywords, language, linalg, report, rows, samples, sketches, tokens
from .operators.cascade import cascade, strong, verdict_columns, weak
from .operators.stages import BlocklistStage, ClassifierStage, chat_messages, density_scorer, parse_completion
from .sources import arrow, readers
from .sources.shared import new_folder, written
from .streaming import events as event_streams

#: A benign blocklist, in order.
KEYWORDS = ["Apache", "License", "idiot", "license", "moron", "password", "stupid", "trash"]
TERMS = ["the", "of", "and", "die", "que", "le", "un", "und", "el", "that"]
CONTEXT, SCORE = 64, 0.15

_REGISTERED: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    def register(f):
        _REGISTERED[f.__name__] = (f, sql)
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id")


def stages() -> list:
    return [BlocklistStage(KEYWORDS, 1), ClassifierStage(density_scorer(TERMS), SCORE, CONTEXT)]


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict table that assembly and reports start from: judged once and written, as they read it several times."""
    return written(cascade(corpus(spark, sf_dir), stages()).drop("text", "n_chars"))


def _list(items: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


_WORDS = r"list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')"
_HITS = f"list_filter({_list(KEYWORDS)}, lambda k: contains(lower(text), lower(k)))"
_JUDGED = f"""
h AS (SELECT doc_id AS id, lang, source, text, n_chars, {_HITS} AS hits, {_WORDS} AS ws FROM documents),
p AS (SELECT *, list_transform(range(0, len(ws), {CONTEXT}), lambda i: ws[i + 1 : i + {CONTEXT}]) AS parts FROM h),
s AS (SELECT *, list_transform(parts, lambda q: len(list_filter(q, lambda w: list_contains({_list(TERMS)}, lower(w))))::DOUBLE / len(q)) AS scores FROM p),
v AS (SELECT id, lang, source, text, n_chars, len(hits) >= 1 AS word_filter, array_to_string(hits[1:1], ', ') AS keywords,
  CASE WHEN len(hits) >= 1 THEN len(scores) = 0 OR list_max(scores) > {SCORE} ELSE false END AS bert_filter,
  CASE WHEN len(hits) >= 1 AND len(scores) > 0 THEN list_max(scores) ELSE 0.0 END AS highest_score,
  CASE WHEN len(hits) >= 1 AND len(scores) > 0 THEN list_min(scores) ELSE 0.0 END AS lowest_score,
  CASE WHEN len(hits) >= 1 AND len(scores) > 0 THEN list_avg(scores) ELSE 0.0 END AS mean_score FROM s)
"""


#: A blocklist from the labelled documents: of each word the share of toxic ones among its documents, and whether it is in three and more (unknown for a single one).
_RATED = r"""r AS (SELECT w AS keyword, avg(toxic) AS pos_ratio, CASE WHEN count(*) > 1 THEN count(*) >= 3 END AS is_relevant
  FROM (SELECT DISTINCT doc_id, unnest(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS w FROM documents) JOIN labels USING (doc_id) GROUP BY w)"""


def rated_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(text_functions.words(F.col("text")))).alias("keyword"))
    n = F.count("*")
    return words.join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id").groupBy("keyword").agg(F.avg("toxic").alias("pos_ratio"), F.when(n > 1, n >= 3).alias("is_relevant"))


@query(f"WITH {_RATED} SELECT keyword FROM r WHERE pos_ratio > 0.4 AND is_relevant")
def blocklist_refine(spark, sf_dir):
    return blocklist.refine(rated_words(spark, sf_dir))


@query(f"WITH {_RATED} SELECT count(*) AS n_before, count(*) FILTER (WHERE ok) AS n_after, count(DISTINCT keyword) FILTER (WHERE ok) AS n_keywords FROM (SELECT keyword, coalesce(pos_ratio > 0.4 AND is_relevant, false) AS ok FROM r)")
def blocklist_refine_counts(spark, sf_dir):
    return blocklist.refine_counts(rated_words(spark, sf_dir))


@query(f"SELECT doc_id, len(h) >= 2 AS word_filter, array_to_string(h[1:2], ', ') AS keywords FROM (SELECT doc_id, {_HITS} AS h FROM documents)")
def blocklist_hits(spark, sf_dir):
    v = table(spark, sf_dir, "documents").select("doc_id", blocklist.verdict(F.col("text"), KEYWORDS, 2).alias("v"))
    return v.select("doc_id", F.col("v.should_filter").alias("word_filter"), F.col("v.metadata.keywords").alias("keywords"))


@query(f"SELECT lang, count(*) AS n, count(*) FILTER (WHERE len(h) >= 1) AS n_filtered FROM (SELECT lang, {_HITS} AS h FROM documents) GROUP BY lang")
def blocklist_by_lang(spark, sf_dir):
    v = table(spark, sf_dir, "documents").select("lang", blocklist.verdict(F.col("text"), KEYWORDS, 1)["should_filter"].alias("v"))
    return v.groupBy("lang").agg(F.count("*").alias("n"), F.count_if("v").alias("n_filtered"))


@query(f"SELECT t AS threshold, count(*) FILTER (WHERE n >= t) AS n_filtered FROM (SELECT len({_HITS}) AS n FROM documents), (VALUES (1), (2), (3)) x(t) GROUP BY t")
def blocklist_threshold_sweep(spark, sf_dir):
    n = table(spark, sf_dir, "documents").select(F.size(blocklist.hits(F.col("text"), KEYWORDS, 3)).alias("n"))
    return n.select("n", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("threshold")).groupBy("threshold").agg(F.count_if(F.col("n") >= F.col("threshold")).alias("n_filtered"))


_MANY = [f"w{i}" for i in range(60)] + KEYWORDS


@query(f"SELECT doc_id, len(list_filter({_list(sorted(_MANY))}, lambda k: contains(lower(text), lower(k)))) >= 1 AS word_filter FROM documents")
def blocklist_large(spark, sf_dir):
    """A list of 68 keywords, which go to the automaton without being looked for first."""
    return table(spark, sf_dir, "documents").select("doc_id", blocklist.verdict(F.col("text"), sorted(_MANY), 1)["should_filter"].alias("word_filter"))


@query(f"WITH {_JUDGED} SELECT id, word_filter, keywords, bert_filter, round(highest_score, 9) AS highest_score, round(lowest_score, 9) AS lowest_score, round(mean_score, 9) AS mean_score, bert_filter AS combined_filter FROM v")
def cascade_verdicts(spark, sf_dir):
    v = verdicts(spark, sf_dir)
    scores = [F.round(f"bert_filter_metadata.{k}", 9).alias(k) for k in ("highest_score", "lowest_score", "mean_score")]
    return v.select("id", "word_filter", F.col("word_filter_metadata.keywords").alias("keywords"), "bert_filter", *scores, "combined_filter")


@query(f"WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents), p AS (SELECT doc_id, unnest(list_transform(range(0, len(ws), {CONTEXT}), lambda i: ws[i + 1 : i + {CONTEXT}])) AS q, unnest(range(0, len(ws), {CONTEXT})) // {CONTEXT} AS chunk FROM w) SELECT doc_id, chunk::INTEGER AS chunk, len(q)::INTEGER AS num_tokens, round(len(list_filter(q, lambda w: list_contains({_list(TERMS)}, lower(w))))::DOUBLE / len(q), 9) AS score FROM p")
def classifier_chunk_scores(spark, sf_dir):
    parts = tokens.chunks(table(spark, sf_dir, "documents"), CONTEXT, id_col="doc_id")
    return parts.select("doc_id", "chunk", F.size("tokens").alias("num_tokens"), F.round(density_scorer(TERMS)(F.col("tokens")), 9).alias("score"))


@query(f"WITH {_JUDGED} SELECT id, highest_score >= 0.25 AS bert_filter, bert_filter AS combined_filter FROM v")
def rethreshold_compat(spark, sf_dir):
    return assemble.rethreshold(verdicts(spark, sf_dir), 0.25, compat=True).select("id", "bert_filter", "combined_filter")


@query(f"WITH {_JUDGED} SELECT id, word_filter AND highest_score >= 0.25 AS bert_filter, word_filter AND highest_score >= 0.25 AS combined_filter FROM v")
def rethreshold_fixed(spark, sf_dir):
    return assemble.rethreshold(verdicts(spark, sf_dir), 0.25).select("id", "bert_filter", "combined_filter")


@query(f"WITH {_JUDGED} SELECT id, lang, source, n_chars FROM v WHERE NOT bert_filter")
def retained_docs(spark, sf_dir):
    return assemble.retained(corpus(spark, sf_dir), verdicts(spark, sf_dir)).select("id", "lang", "source", "n_chars")


@query(f"WITH {_JUDGED} SELECT id, text FROM v WHERE bert_filter")
def filtered_docs(spark, sf_dir):
    return assemble.removed(corpus(spark, sf_dir), verdicts(spark, sf_dir)).select("id", "text")


@query(f"WITH {_JUDGED} SELECT id, (1 + (word_filter AND NOT bert_filter)::INT)::BIGINT AS n FROM v WHERE NOT bert_filter")
def reappended_docs(spark, sf_dir):
    base, v = corpus(spark, sf_dir), verdicts(spark, sf_dir)
    return assemble.reappend(assemble.retained(base, v), base, v).groupBy("id").agg(F.count("*").alias("n"))


@query(f"WITH {_JUDGED} SELECT id, 1::BIGINT AS n FROM v WHERE NOT (word_filter AND bert_filter)")
def restored_docs(spark, sf_dir):
    """With the blocklist's verdict as decision, re-appending restores what the classifier approves."""
    base, v = corpus(spark, sf_dir), verdicts(spark, sf_dir)
    return assemble.reappend(assemble.retained(base, v, "word_filter"), base, v).groupBy("id").agg(F.count("*").alias("n"))


@query("SELECT CAST(doc_id AS VARCHAR) AS id, source, text FROM documents UNION ALL SELECT 'benchmark-' || (row_number() OVER (ORDER BY item_id) - 1), 'benchmark', text FROM benchmark")
def insert_union(spark, sf_dir):
    return assemble.insert(corpus(spark, sf_dir), table(spark, sf_dir, "benchmark"), "benchmark", "item_id", seed=None)


@query()
def deterministic_shuffle(spark, sf_dir):
    return rows.seeded_shuffle(corpus(spark, sf_dir).select("id", "lang"), "id", 42)


@query(f"WITH {_JUDGED} SELECT count(*) AS original_dataset_size, count(*) FILTER (WHERE bert_filter) AS filtered_records_size, count(*) FILTER (WHERE NOT bert_filter) AS retained_dataset_size, 0::BIGINT AS num_insert_samples, 100.0 * count(*) FILTER (WHERE bert_filter) / count(*) AS filtered_percentage, 100.0 * count(*) FILTER (WHERE NOT bert_filter) / count(*) AS retention_percentage FROM v")
def assembly_stats(spark, sf_dir):
    base, v = corpus(spark, sf_dir), verdicts(spark, sf_dir)
    return assemble.assembly_stats(base, v, assemble.retained(base, v))


@query("SELECT (SELECT count(*) FROM documents) AS n_base, (SELECT count(*) FROM labels) AS n_verdicts, 100.0 * (SELECT count(*) FROM labels) / (SELECT count(*) FROM documents) AS coverage_percent, 'partial' AS status")
def coverage(spark, sf_dir):
    return assemble.coverage(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(f"WITH {_JUDGED} SELECT source, count(*) AS n FROM v WHERE word_filter AND NOT bert_filter GROUP BY source")
def appended_sources(spark, sf_dir):
    return assemble.appended_sources(assemble.approved_escalations(corpus(spark, sf_dir), verdicts(spark, sf_dir)))


_LABELLED = f"{_JUDGED}, j AS (SELECT v.*, toxic = 1 AS is_filter_target FROM v JOIN labels ON id = doc_id)"
_CELLS = """count(*) AS n, count(*) FILTER (WHERE NOT word_filter AND NOT is_filter_target) AS tn, count(*) FILTER (WHERE word_filter AND NOT is_filter_target) AS fp,
  count(*) FILTER (WHERE NOT word_filter AND is_filter_target) AS fn, count(*) FILTER (WHERE word_filter AND is_filter_target) AS tp"""
_RATES = "n, tn, fp, fn, tp, fp + tp AS num_filtered, (fp + tp)::DOUBLE / n AS percent_filtered, coalesce(fp::DOUBLE / nullif(fp + tn, 0), 0.0) AS fpr"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (F.col("toxic") == 1).alias("is_filter_target"))
    return verdicts(spark, sf_dir).join(labels, "id")


@query(f"WITH {_LABELLED}, c AS (SELECT {_CELLS} FROM j) SELECT {_RATES} FROM c")
def confusion(spark, sf_dir):
    return report.confusion(labelled(spark, sf_dir), "word_filter", "is_filter_target")


@query(f"WITH {_LABELLED}, c AS (SELECT lang, {_CELLS} FROM j GROUP BY ROLLUP (lang)) SELECT lang, {_RATES} FROM c")
def report_rollup(spark, sf_dir):
    return report.confusion(labelled(spark, sf_dir), "word_filter", "is_filter_target", ["lang"], rollup=True)


@query(f"""WITH {_LABELLED}, c AS (SELECT {_CELLS} FROM j),
r AS (SELECT 'false' AS label, coalesce(tn::DOUBLE / nullif(tn + fn, 0), 0.0) AS precision, coalesce(tn::DOUBLE / nullif(tn + fp, 0), 0.0) AS recall, tn + fp AS support, (tn + tp)::DOUBLE / n AS accuracy FROM c
  UNION ALL SELECT 'true', coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0.0), coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0.0), tp + fn, (tn + tp)::DOUBLE / n FROM c),
f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1 FROM r),
a AS (SELECT label, precision, recall, f1, support, accuracy FROM f
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support), any_value(accuracy) FROM f
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support), any_value(accuracy) FROM f)
SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support::BIGINT AS support, round(accuracy, 9) AS accuracy FROM a""")
def class_report(spark, sf_dir):
    out = report.class_report(labelled(spark, sf_dir), "word_filter", "is_filter_target")
    return out.select("label", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support", F.round("accuracy", 9).alias("accuracy"))


@query(f"WITH {_JUDGED}, u AS (UNPIVOT (SELECT word_filter, bert_filter, bert_filter AS combined_filter FROM v) ON word_filter, bert_filter, combined_filter INTO NAME column_name VALUE x) SELECT column_name, count(*) FILTER (WHERE x) AS n_true, count(*) FILTER (WHERE NOT x) AS n_false, 0::BIGINT AS n_null, 100.0 * count(*) FILTER (WHERE x) / count(*) AS percent_true FROM u GROUP BY column_name")
def profile_bool_columns(spark, sf_dir):
    return report.profile(verdicts(spark, sf_dir))


@query("SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS id FROM documents")
def row_ids(spark, sf_dir):
    return rows.row_index(table(spark, sf_dir, "documents").select("doc_id", "source"), ["source", "doc_id"], "id").select("doc_id", "id")


@query("SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS id FROM documents")
def row_ids_by_split(spark, sf_dir):
    return rows.ensure_id(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "lang")


@query("WITH n AS (SELECT count(*) AS n, greatest(1, floor(count(*) * 0.07))::BIGINT AS c FROM documents), i AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) SELECT doc_id, i // c AS chunk_idx, 'train[' || (100 * (i // c) * c) // n || '%:' || (100 * least((i // c) * c + c, n)) // n || '%]' AS chunk_label FROM i, n")
def percent_chunks(spark, sf_dir):
    return rows.percent_chunks(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.07)


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) WHERE i % 4 = 1")
def rank_shard(spark, sf_dir):
    return rows.shard(table(spark, sf_dir, "documents").select("doc_id"), 4, 1, "doc_id")


@query(f"SELECT doc_id, len({_WORDS})::INTEGER AS num_tokens FROM documents")
def token_counts(spark, sf_dir):
    return tokens.token_counts(table(spark, sf_dir, "documents"), id_col="doc_id")


@query(f"WITH c AS (SELECT doc_id, sum(len({_WORDS})) OVER (ORDER BY doc_id) AS r, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents), h AS (SELECT min(r) FILTER (WHERE r >= 100000) AS r, count(*) FILTER (WHERE r < 100000) AS below, max(r) AS total, count(*) AS n FROM c) SELECT r IS NOT NULL AS reached_target_token_count, CASE WHEN r IS NOT NULL THEN below ELSE greatest(n - 1, 0) END AS final_index, least(CASE WHEN r IS NOT NULL THEN below ELSE greatest(n - 1, 0) END + 1, n) AS num_docs, 100000::BIGINT AS target_token_count, coalesce(r, total, 0)::BIGINT AS actual_token_count FROM h")
def token_budget_cut(spark, sf_dir):
    return tokens.budget_cut(tokens.token_counts(table(spark, sf_dir, "documents"), id_col="doc_id"), 100_000, ["doc_id"])


@query(f"WITH c AS (SELECT doc_id, sum(len({_WORDS})) OVER (ORDER BY doc_id) AS running FROM documents) SELECT doc_id, running::BIGINT AS running FROM c")
def running_tokens(spark, sf_dir):
    """The two-level running sum."""
    counts = tokens.token_counts(table(spark, sf_dir, "documents"), id_col="doc_id")
    return rows.running_sum(counts, F.col("num_tokens").cast("bigint"), ["doc_id"], "running").select("doc_id", "running")


@query(f"WITH t AS (SELECT doc_id, unnest(list_concat(['<eos>'], {_WORDS})) AS t, unnest(range(0, len({_WORDS}) + 1)) AS k FROM documents), o AS (SELECT t, row_number() OVER (ORDER BY doc_id, k) - 1 AS i FROM t), p AS (SELECT i // 2048 AS seq_id, string_agg(t, ' ' ORDER BY i) AS tokens, count(*) AS n FROM o GROUP BY 1) SELECT seq_id, md5(tokens) AS tokens_md5, 2048::INTEGER AS n FROM p WHERE n = 2048")
def pack_sequences(spark, sf_dir):
    packed = tokens.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), 2048, ["doc_id"])
    return packed.select("seq_id", F.md5(F.array_join("input_ids", " ").cast("binary")).alias("tokens_md5"), F.size("input_ids").alias("n"))


@query(f"WITH i AS (SELECT doc_id, list_transform({_WORDS}, lambda w: length(w)) AS ids FROM documents), p AS (SELECT doc_id, unnest(list_transform(range(0, least(len(ids), 640), 128), lambda k: ids[k + 1 : k + 128])) AS c, unnest(range(0, least(len(ids), 640), 128)) // 128 AS chunk FROM i) SELECT doc_id, chunk::INTEGER AS chunk, list_sum(c)::BIGINT AS ids_sum, len(c)::INTEGER AS n_real, (list_sum(c) - 100 * (128 - len(c)))::BIGINT AS labels_sum FROM p")
def chunk_pad(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.transform(text_functions.words(F.col("text")), F.length).alias("input_ids"))
    add = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    out = tokens.chunk_pad(docs, 128, 5)
    return out.select("doc_id", "chunk", add("input_ids").alias("ids_sum"), add("attention_mask").cast("int").alias("n_real"), add("labels").alias("labels_sum"))


@query("SELECT label AS layer, i - 1 AS i, j - 1 AS j, round(sum(a::DOUBLE * b::DOUBLE), 6) + 0.0 AS g FROM (SELECT label, unnest(embedding) AS a, generate_subscripts(embedding, 1) AS i, embedding FROM embeddings) x, LATERAL (SELECT unnest(x.embedding) AS b, generate_subscripts(x.embedding, 1) AS j) y GROUP BY ALL")
def gram_matrix(spark, sf_dir):
    g = linalg.gram(table(spark, sf_dir, "embeddings").withColumnRenamed("label", "layer"), "embedding")
    return g.select("layer", F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), (F.round("g", 6) + 0.0).alias("g"))


@query("SELECT label AS layer, count(DISTINCT vec_id) AS n_samples, 64 AS hidden_dim, round(sum(a::DOUBLE * a::DOUBLE), 4) AS trace FROM (SELECT vec_id, label, unnest(embedding) AS a FROM embeddings) GROUP BY label")
def layer_spectrum_trace(spark, sf_dir):
    s = linalg.spectrum(table(spark, sf_dir, "embeddings").withColumnRenamed("label", "layer"), "embedding")
    return s.select("layer", "n_samples", "hidden_dim", F.round(vectors.dot(F.col("singular_values"), F.col("singular_values")), 4).alias("trace"))


@query("WITH n AS (SELECT count(*) AS n FROM embeddings) SELECT DISTINCT batch::INTEGER AS batch FROM (SELECT floor(pow(2, i / 2.0)) AS batch FROM range(0, 80) r(i), n WHERE floor(pow(2, i / 2.0)) <= n UNION ALL SELECT n FROM n WHERE n > 0)")
def checkpoint_schedule(spark, sf_dir):
    """At which of the vectors a running spectrum is saved."""
    n = table(spark, sf_dir, "embeddings").count()
    return spark.createDataFrame([(b,) for b in linalg.checkpoint_schedule(n)], "batch int")


_CHECKPOINT_SQL = "SELECT label AS layer, c AS checkpoint, i - 1 AS i, j - 1 AS j, round(sum(a::DOUBLE * b::DOUBLE), 6) + 0.0 AS g FROM (SELECT vec_id % 16 + 1 AS batch, label, unnest(embedding) AS a, generate_subscripts(embedding, 1) AS i, embedding FROM embeddings) x JOIN (VALUES (1), (2), (4), (5), (8), (11), (16)) p(c) ON batch <= c, LATERAL (SELECT unnest(x.embedding) AS b, generate_subscripts(x.embedding, 1) AS j) y GROUP BY ALL"


def batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("layer"), F.col("embedding").alias("x"), (F.col("vec_id") % 16 + 1).cast("int").alias("batch"))


@query(_CHECKPOINT_SQL)
def checkpointed_grams(spark, sf_dir):
    """The whole Gram matrix at each checkpoint."""
    g = linalg.checkpointed_grams(batched(spark, sf_dir), "batch", linalg.checkpoint_schedule(16))
    return g.select("layer", "checkpoint", F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), (F.round("g", 6) + 0.0).alias("g"))


#: Vectors folded to two components, of which SQL can solve the spectrum: its eigenvalues are those of a 2 * 2 matrix.
_FOLDED_SQL = """f AS (SELECT vec_id, label AS layer, vec_id % 16 + 1 AS batch, list_sum(embedding[1:32]::DOUBLE[]) AS u, list_sum(embedding[33:64]::DOUBLE[]) AS v FROM embeddings)"""
_EIGEN_SQL = """e AS (SELECT *, (a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b) AS hi, (a + c) / 2 - sqrt(pow((a - c) / 2, 2) + b * b) AS lo FROM m)
SELECT {keys}, n AS n_samples, 2 AS hidden_dim, round(sqrt(hi), 6) AS first, round(sqrt(greatest(lo, 0)), 6) AS second, round(sqrt(hi) / sqrt(lo), 6) AS condition_number FROM e"""


def folded(df: DataFrame) -> DataFrame:
    add = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double"))
    return df.withColumn("x", F.array(add(F.slice("x", 1, 32)), add(F.slice("x", 33, 32))))


def _values(spectra: DataFrame, *keys: str) -> DataFrame:
    return spectra.select(*keys, "n_samples", "hidden_dim", F.round(F.col("top5")[0], 6).alias("first"), F.round(F.col("top5")[1], 6).alias("second"), F.round("condition_number", 6).alias("condition_number"))


@query(f"WITH {_FOLDED_SQL}, m AS (SELECT layer, count(*) AS n, sum(u * u) AS a, sum(u * v) AS b, sum(v * v) AS c FROM f GROUP BY layer), {_EIGEN_SQL.format(keys='layer')}")
def singular_values(spark, sf_dir):
    """The singular values themselves, their preview and the condition number."""
    return _values(linalg.spectrum(folded(batched(spark, sf_dir))), "layer")


@query("""WITH c AS (SELECT label AS layer, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
g AS (SELECT a.layer, a.i AS i, b.i AS j, sum(a.x * b.x) AS g FROM c a JOIN c b ON a.layer = b.layer AND a.vec_id = b.vec_id GROUP BY ALL),
t AS (SELECT layer, sum(g) FILTER (WHERE i = j) AS t1, sum(g * g) AS t2 FROM g GROUP BY layer),
h AS (SELECT a.layer, a.i, b.j, sum(a.g * b.g) AS h FROM g a JOIN g b ON a.layer = b.layer AND a.j = b.i GROUP BY ALL),
u AS (SELECT layer, sum(g.g * h.h) AS t3, sum(h.h * h.h) AS t4 FROM g JOIN h USING (layer, i, j) GROUP BY layer)
SELECT layer, round(t2 / t1 ** 2, 9) AS s2, round(t3 / t1 ** 3, 9) AS s3, round(t4 / t1 ** 4, 9) AS s4 FROM t JOIN u USING (layer)""")
def spectrum_power_sums(spark, sf_dir):
    """Sums of the fourth, sixth and eighth powers of all 64 singular values of each layer, as shares of powers of the sum of their squares; SQL has them from the Gram matrix's powers."""
    s = linalg.spectrum(table(spark, sf_dir, "embeddings").withColumnRenamed("label", "layer"), "embedding")
    power = lambda k: F.aggregate("singular_values", F.lit(0.0), lambda a, v: a + F.pow(v, F.lit(2.0 * k)))
    return s.select("layer", *[F.round(power(k) / F.pow(power(1), F.lit(float(k))), 9).alias(f"s{k}") for k in (2, 3, 4)])


@query("SELECT source, count(*) AS n, min(n_chars)::DOUBLE AS low, max(n_chars)::DOUBLE AS high, true AS quantiles_hold, true AS distinct_holds FROM documents GROUP BY source")
def source_sketches(spark, sf_dir):
    """Summaries of each language merged by source, and whether they are as near to the exact quantiles and distinct counts as they promise."""
    docs = table(spark, sf_dir, "documents")
    told = sketches.summary(sketches.merged(written(sketches.sketched(docs, ["lang", "source"], "n_chars", "text")), ["source"]), [0.1, 0.25, 0.5, 0.75, 0.9])
    found = F.posexplode("quantile_values").alias("k", "q")
    asked = F.array(*map(F.lit, [0.1, 0.25, 0.5, 0.75, 0.9]))
    each = docs.select("source", "n_chars").join(F.broadcast(told.select("source", found)), "source")  # five rows a source
    ranks = each.groupBy("source", "k", "q").agg(F.avg((F.col("n_chars") < F.col("q")).cast("double")).alias("below"), F.avg((F.col("n_chars") <= F.col("q")).cast("double")).alias("upto"))
    near = (F.col("below") <= asked[F.col("k")] + sketches.QUANTILE_ERROR) & (F.col("upto") >= asked[F.col("k")] - sketches.QUANTILE_ERROR)
    holds = ranks.groupBy("source").agg(F.bool_and(near).alias("quantiles_hold"))
    exact = docs.groupBy("source").agg(F.count_distinct("text").alias("exact"))
    right = F.abs(F.col("n_distinct") - F.col("exact")) <= sketches.DISTINCT_ERROR * F.col("exact")
    return told.join(holds, "source").join(exact, "source").select("source", "n", "low", "high", "quantiles_hold", right.alias("distinct_holds"))


@query(f"WITH {_FOLDED_SQL}, m AS (SELECT layer, k AS checkpoint, count(*) AS n, sum(u * u) AS a, sum(u * v) AS b, sum(v * v) AS c FROM f JOIN (VALUES (1), (2), (4), (5), (8), (11), (16)) p(k) ON batch <= k GROUP BY layer, k), {_EIGEN_SQL.format(keys='layer, checkpoint').replace(', round(sqrt(hi) / sqrt(lo), 6) AS condition_number', '')}")
def checkpointed_spectrum(spark, sf_dir):
    """Without the condition number, which has no digits to compare where a checkpoint has a single row."""
    return _values(linalg.checkpointed_spectrum(folded(batched(spark, sf_dir)), "batch", linalg.checkpoint_schedule(16)), "layer", "checkpoint").drop("condition_number")


_PAIRS = "p AS (SELECT a.vec_id, a.label AS layer, a.embedding::DOUBLE[] AS student, b.embedding::DOUBLE[] AS teacher FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"


def vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    left = e.select("vec_id", F.col("label").alias("layer"), F.col("embedding").cast("array<double>").alias("student"))
    return left.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").cast("array<double>").alias("teacher")), "vec_id")


@query(f"WITH {_PAIRS} SELECT vec_id, round(list_sum(list_transform(list_zip(student, teacher), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / 64, 9) AS mse FROM p")
def vector_mse(spark, sf_dir):
    return vector_pairs(spark, sf_dir).select("vec_id", F.round(vectors.mean_squared_error(F.col("student"), F.col("teacher")), 9).alias("mse"))


@query(f"WITH {_PAIRS}, c AS (SELECT layer, list_cosine_similarity(student, teacher) AS c, list_sum(list_transform(list_zip(student, teacher), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / 64 AS m FROM p) SELECT layer, round(avg(m), 8) AS mse, round(avg(pow(1 - c, 3)), 8) AS cos_cubed, round(avg(30 * (1 - c)), 8) AS cos_30, round(avg(10 * pow(1 - c, 3)), 8) AS cos_cubed_10 FROM c GROUP BY layer")
def cosine_losses(spark, sf_dir):
    out = linalg.layer_losses(vector_pairs(spark, sf_dir))
    return out.select("layer", *[F.round(c, 8).alias(c) for c in out.columns if c != "layer"])


@query(f"WITH {_PAIRS}, s AS (SELECT vec_id, list_transform(student, lambda x: exp(x / 2)) AS a, list_transform(teacher, lambda x: exp(x / 2)) AS b FROM p), n AS (SELECT vec_id, list_transform(a, lambda x: x / list_sum(a)) AS a, list_transform(b, lambda x: x / list_sum(b)) AS b FROM s) SELECT vec_id, round(4 * list_sum(list_transform(list_zip(a, b), lambda z: z[2] * (ln(z[2]) - ln(z[1])))), 8) AS kl FROM n")
def kl_divergence(spark, sf_dir):
    p = vector_pairs(spark, sf_dir)
    return p.select("vec_id", F.round(vectors.distillation(F.col("student"), F.col("teacher"), 2.0), 8).alias("kl"))


@query("SELECT label AS layer, i - 1 AS position, round(avg(a::DOUBLE * a::DOUBLE), 9) AS mean_square FROM (SELECT label, unnest(embedding) AS a, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL")
def position_mean_square(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("layer"), F.posexplode("embedding").alias("position", "v"))
    out = linalg.mean_square(e.withColumn("v", F.array("v")), "v", ["layer", "position"])
    return out.select("layer", F.col("position").cast("bigint").alias("position"), F.round("mean_square", 9).alias("mean_square"))


_ITEMS = "i AS (SELECT doc_id, lang AS category, CASE WHEN doc_id % 3 = 0 THEN 'robust' ELSE 'shortcut' END AS subset, [-(n_chars % 7), -(n_chars % 5), -(n_chars % 3), -(n_chars % 4)]::DOUBLE[] AS loglik, [lang, source, lang || source, source || source] AS choices, (doc_id % 4)::INTEGER AS answer, source FROM documents)"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    loglik = F.array(*[(-(n % k)).cast("double") for k in (7, 5, 3, 4)])
    choices = F.array("lang", "source", F.concat("lang", "source"), F.concat("source", "source"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.col("lang").alias("category"), F.when(F.col("doc_id") % 3 == 0, "robust").otherwise("shortcut").alias("subset"),
        loglik.alias("loglik"), choices.alias("choices"), (F.col("doc_id") % 4).cast("int").alias("answer"), "source",
    )


@query(f"WITH {_ITEMS} SELECT doc_id, 'Choose.' || source || chr(10) || 'A. ' || choices[1] || chr(10) || 'B. ' || choices[2] || chr(10) || 'C. ' || choices[3] || chr(10) || 'D. ' || choices[4] || chr(10) || 'Answer:' AS prompt, 'Question: ' || source || chr(10) || 'Answer:' AS cloze FROM i")
def mcq_prompt(spark, sf_dir):
    it = evals.check_choices(items(spark, sf_dir))
    return it.select("doc_id", text_functions.mcq_prompt(F.col("source"), F.col("choices"), "Choose.").alias("prompt"), text_functions.cloze_prompt(F.col("source")).alias("cloze"))


_SCORED = f"{_ITEMS}, n AS (SELECT *, list_transform(list_zip(loglik, choices), lambda z: z[1] / length(z[2])) AS norm FROM i), s AS (SELECT *, (list_position(loglik, list_max(loglik)) - 1 = answer)::INT::DOUBLE AS acc, (list_position(norm, list_max(norm)) - 1 = answer)::INT::DOUBLE AS acc_norm FROM n)"


@query(f"WITH {_SCORED} SELECT doc_id, acc, acc_norm FROM s")
def mcq_acc(spark, sf_dir):
    return evals.scored(items(spark, sf_dir)).select("doc_id", "acc", "acc_norm")


_LEAVES = f"{_SCORED}, t AS (SELECT subset, category, count(*) AS n, avg(acc) AS acc, stddev_samp(acc) / sqrt(count(*)) AS stderr FROM s GROUP BY ALL)"
_POOL = "sum(n)::BIGINT AS n, sum(n * acc) / sum(n) AS acc, sqrt(sum((n - 1) * stderr * stderr * n) / ((sum(n) - count(*)) * sum(n))) AS stderr"


@query(f"WITH {_LEAVES}, a AS (SELECT subset, category, n, acc, stderr, 0 AS level FROM t UNION ALL SELECT subset, NULL, {_POOL}, 1 FROM t GROUP BY subset UNION ALL SELECT NULL, NULL, {_POOL}, 2 FROM t) SELECT subset, category, n, round(acc, 9) AS acc, round(stderr, 9) AS stderr, level FROM a")
def group_accuracy(spark, sf_dir):
    out = evals.nested_accuracy(evals.scored(items(spark, sf_dir)))
    return out.select("subset", "category", "n", F.round("acc", 9).alias("acc"), F.round("stderr", 9).alias("stderr"), "level")


@query(f"WITH {_SCORED}, m AS (SELECT source AS model, avg(acc) AS acc FROM s GROUP BY source) SELECT model, round(acc, 9) AS acc, round(acc - (SELECT acc FROM m WHERE model = 'src0'), 9) AS acc_delta FROM m")
def model_deltas(spark, sf_dir):
    models = evals.scored(items(spark, sf_dir)).groupBy(F.col("source").alias("model")).agg(F.avg("acc").alias("acc"))
    out = evals.compared(models, "src0")
    return out.select("model", F.round("acc", 9).alias("acc"), F.round("acc_delta", 9).alias("acc_delta"))


@query(f"WITH {_ITEMS}, g AS (SELECT doc_id FROM i, (VALUES (1), (2), (3)) x(m) GROUP BY doc_id HAVING count(*) FILTER (WHERE (doc_id * m) % 5 < 2) >= 3) SELECT doc_id FROM i WHERE doc_id NOT IN (SELECT doc_id FROM g)")
def without_shortcuts(spark, sf_dir):
    it = items(spark, sf_dir)
    guesses = it.select(F.col("doc_id").alias("item"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("model")).withColumn("correct", (F.col("item") * F.col("model")) % 5 < 2)
    return evals.without_shortcuts(it.withColumnRenamed("doc_id", "item"), guesses).select(F.col("item").alias("doc_id"))


_COMPLETED = "c AS (SELECT conv_id, turn, coalesce(text, '') || CASE (conv_id + turn) % 6 WHEN 0 THEN ' [1]' WHEN 1 THEN '[' || turn || '] so [' || (turn % 3) WHEN 2 THEN '[x] 12' WHEN 3 THEN '[' WHEN 4 THEN ' [' || (turn % 12) || ']' ELSE '' END AS c FROM conversations)"


@query(f"WITH {_COMPLETED} SELECT conv_id, turn, coalesce(try_cast(nullif(regexp_extract(list_extract(string_split(c, '['), -1), '\\d'), '') AS INTEGER) = 1, true) AS judgment, nullif(regexp_extract(list_extract(string_split(c, '['), -1), '\\d'), '') IS NULL AS failed FROM c")
def lm_parse(spark, sf_dir):
    """Judgments from turns of conversations as completions, some with brackets and digits, some without."""
    turn, kind = F.col("turn"), (F.col("conv_id") + F.col("turn")) % 6
    tail = F.when(kind == 0, " [1]").when(kind == 1, F.concat(F.lit("["), turn, F.lit("] so ["), turn % 3)).when(kind == 2, "[x] 12").when(kind == 3, "[").when(kind == 4, F.concat(F.lit(" ["), turn % 12, F.lit("]"))).otherwise("")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", parse_completion(F.concat(F.coalesce("text", F.lit("")), tail)).alias("p"))
    return c.select("conv_id", "turn", F.col("p.judgment").alias("judgment"), F.col("p.error").isNotNull().alias("failed"))


@query("SELECT conv_id, turn, CASE WHEN contains(text, ' the ') THEN regexp_replace(string_split(text, ' the ')[1], '^\\s+|\\s+$', '', 'g') ELSE text END AS text FROM conversations")
def sentinel_truncate(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text_functions.until(F.col("text"), " the ").alias("text"))


@query("SELECT conv_id, turn, 'system' AS first_role, 'Judge this.' AS prompt, 'user' AS last_role, text AS content FROM conversations")
def prompt_messages(spark, sf_dir):
    m = table(spark, sf_dir, "conversations").select("conv_id", "turn", chat_messages(F.col("text"), "Judge this.").alias("m"))
    return m.select("conv_id", "turn", F.col("m")[0]["role"].alias("first_role"), F.col("m")[0]["content"].alias("prompt"), F.col("m")[1]["role"].alias("last_role"), F.col("m")[1]["content"].alias("content"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '...' ELSE text END AS preview, length(text) AS n FROM documents")
def preview(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text_functions.shortened(F.col("text")).alias("preview"), F.length("text").cast("bigint").alias("n"))


@query("SELECT doc_id, lang || chr(10) || chr(10) || source || chr(10) || chr(10) || text AS article FROM documents")
def article_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text_functions.article(F.col("lang"), F.col("source"), F.col("text")).alias("article"))


@query("SELECT name, row_number() OVER (ORDER BY coalesce(try_cast(nullif(regexp_extract(name, '\\d+'), '') AS INTEGER), 100), name) AS place FROM (SELECT DISTINCT 'layers.' || (vec_id % 31) || '.mlp' AS name FROM embeddings) WHERE try_cast(nullif(regexp_extract(name, '\\d+'), '') AS INTEGER) % 6 = 0")
def layer_names(spark, sf_dir):
    from pyspark.sql import Window

    names = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("layers."), (F.col("vec_id") % 31).cast("string"), F.lit(".mlp")).alias("name")).distinct()
    kept = names.where(rows.kept_layers(F.col("name")))
    return kept.select("name", F.row_number().over(Window.orderBy(*rows.layer_order(F.col("name")))).cast("bigint").alias("place"))


@query("SELECT d.lang, l.quality, t.event_type FROM (SELECT DISTINCT lang FROM documents) d, (SELECT DISTINCT quality FROM labels) l, (SELECT DISTINCT event_type FROM events) t")
def parameter_grid(spark, sf_dir):
    """All combinations of what occurs, in a seeded order."""
    langs, marks, kinds = (table(spark, sf_dir, t).select(c).distinct() for t, c in (("documents", "lang"), ("labels", "quality"), ("events", "event_type")))
    return rows.grid(rows.grid(langs, marks), kinds, 42)


@query(f"WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents), f AS (SELECT doc_id, ws, len(ws) = 0 OR len(ws[1]) % 3 = 0 AS failed, len(list_filter(ws, lambda w: list_contains({_list(TERMS)}, lower(w))))::DOUBLE / len(ws) AS score FROM w) SELECT doc_id AS id, failed OR score > {SCORE} AS bert_filter, CASE WHEN failed THEN 0.0 ELSE round(score, 9) END AS highest_score FROM f")
def fail_closed(spark, sf_dir):
    """A classifier that fails on some texts: these are removed, with the default metadata."""
    scorer = lambda part: F.when(F.length(F.get(part, F.lit(0))) % 3 != 0, density_scorer(TERMS)(part))
    v = cascade(corpus(spark, sf_dir), [ClassifierStage(scorer, SCORE, 1_000_000)])
    return v.select("id", "bert_filter", F.round("bert_filter_metadata.highest_score", 9).alias("highest_score"))


@query(f"SELECT doc_id AS id, len({_HITS}) >= 2 AS word_filter, len({_HITS}) >= 2 AS combined_filter FROM documents")
def stage_selection(spark, sf_dir):
    """Stages that are skipped leave no columns."""
    return verdict_columns(cascade(corpus(spark, sf_dir), ["skip", BlocklistStage(KEYWORDS, 2), "SKIP", None])).drop("word_filter_metadata")


@query(f"WITH {_JUDGED} SELECT 'strong' AS policy, count(*) AS n, count(*) FILTER (WHERE word_filter) AS removed FROM v UNION ALL SELECT 'weak', count(*), count(*) FILTER (WHERE bert_filter) FROM v")
def removal_policies(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    found = {"strong": cascade(docs, strong(KEYWORDS, 1)), "weak": cascade(docs, weak(KEYWORDS, ClassifierStage(density_scorer(TERMS), SCORE, CONTEXT), 1))}
    parts = [v.agg(F.count("*").alias("n"), F.count_if("combined_filter").alias("removed")).select(F.lit(k).alias("policy"), "n", "removed") for k, v in found.items()]
    return readers.union_all(parts)


@query(f"WITH {_JUDGED}, k AS (SELECT id, source, row_number() OVER (ORDER BY id) AS i FROM v WHERE NOT bert_filter) SELECT source, count(*) AS n FROM k WHERE i <= (SELECT count(*) FROM v WHERE word_filter AND NOT bert_filter) GROUP BY source")
def counterfactual_sources(spark, sf_dir):
    """Sources of as many retained documents as the appended ones are."""
    base, v = corpus(spark, sf_dir), verdicts(spark, sf_dir)
    return assemble.counterfactual_sources(assemble.retained(base, v), assemble.approved_escalations(base, v))


_LABELS = "l AS (SELECT 'train[' || (item_id * 7 % 100) || '%:' || (item_id * 7 % 100 + 1) || '%]' AS label, (item_id % 13)::VARCHAR AS rank FROM benchmark)"


@query(f"WITH {_LABELS}, d AS (SELECT DISTINCT label, rank FROM l) SELECT label, rank, row_number() OVER (ORDER BY try_cast(regexp_extract(label, '\\[(\\d+)%', 1) AS INTEGER), rank::INTEGER) AS place FROM d")
def chunk_places(spark, sf_dir):
    """Result parts in the order of their start percent and rank, as numbers."""
    start = F.col("item_id") * 7 % 100
    parts = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("train["), start.cast("string"), F.lit("%:"), (start + 1).cast("string"), F.lit("%]")).alias("label"), (F.col("item_id") % 13).cast("string").alias("rank")).distinct()
    keyed = parts.select("label", "rank", *[c.alias(f"k{i}") for i, c in enumerate(rows.chunk_order(F.col("label"), F.col("rank")))])
    return rows.row_index(keyed, ["k0", "k1"], "_i").select("label", "rank", (F.col("_i") + 1).alias("place"))


@query(f"WITH n AS (SELECT (sum(len({_WORDS}) + 1) // 512)::BIGINT AS n FROM documents) SELECT e.epoch::INTEGER AS epoch, s.seq_id // 4 AS batch, count(*) AS n FROM n, range(0, n.n) s(seq_id), range(0, 3) e(epoch) GROUP BY ALL")
def epoch_batches(spark, sf_dir):
    """Sequences repeated by epoch and dealt to batches."""
    packed = tokens.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), 512, ["doc_id"])
    return tokens.batches(tokens.epochs(packed, 3), 4).groupBy("epoch", "batch").agg(F.count("*").alias("n"))


@query("SELECT doc_id, lang, source, to_json({'doc_id': doc_id, 'lang': lang, 'source': source}) AS json FROM documents")
def json_round_trip(spark, sf_dir):
    """Rows to JSON and back."""
    d = table(spark, sf_dir, "documents").select(F.to_json(F.struct("doc_id", "lang", "source")).alias("json"))
    return d.select(F.from_json("json", "doc_id bigint, lang string, source string").alias("r"), "json").select("r.*", "json")


@query("SELECT doc_id, replace(replace(source, 'src', 'part-'), '1', 'one') AS name, printf('%.2f', n_chars / 7) AS ratio, printf('%.0e', n_chars::DOUBLE) AS size, ((n_chars + 99) // 100)::BIGINT AS pages FROM documents")
def formatted(spark, sf_dir):
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").select(
        "doc_id", text_functions.replaced(F.col("source"), ("src", "part-"), ("1", "one")).alias("name"), text_functions.decimals(n / 7).alias("ratio"),
        text_functions.exponent(n).alias("size"), text_functions.ceil_div(n, 100).alias("pages"),
    )


@query(f"WITH {_ITEMS}, k AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY doc_id) AS r FROM i WHERE subset = 'robust') SELECT doc_id, category FROM k WHERE r <= 5")
def limited_items(spark, sf_dir):
    """A subset's items, and of each task the first few."""
    return evals.limited(evals.selected(items(spark, sf_dir), subset="robust"), 5, "doc_id", ["category"]).select("doc_id", "category")


@query(f"WITH {_ITEMS}, s AS (SELECT string_agg('Question: ' || source || chr(10) || 'Answer: ' || answer, chr(10) || chr(10) ORDER BY doc_id) AS shots FROM (SELECT * FROM i WHERE subset = 'shortcut' ORDER BY doc_id LIMIT 16)) SELECT doc_id, s.shots || chr(10) || chr(10) || 'Question: ' || source || chr(10) || 'Answer:' AS prompt FROM i, s WHERE subset = 'robust'")
def few_shot_prompts(spark, sf_dir):
    """Sixteen worked examples before each prompt."""
    it = items(spark, sf_dir).withColumn("prompt", text_functions.cloze_prompt(F.col("source"))).withColumn("answer", F.col("answer").cast("string"))
    return evals.few_shot(evals.selected(it, subset="robust"), evals.selected(it, subset="shortcut"), "prompt", "answer", 16, "doc_id").select("doc_id", "prompt")


@query(f"WITH a AS (SELECT doc_id, list_filter(string_split_regex(lang || chr(10) || chr(10) || source || chr(10) || chr(10) || text, '\\s+'), lambda w: w <> '') AS t FROM documents) SELECT doc_id, greatest(len(t), 300)::INTEGER AS n, len(t)::INTEGER AS n_real, greatest(300 - len(t), 0)::INTEGER AS n_pad FROM a")
def padded_articles(spark, sf_dir):
    """Articles padded to a length, longer ones whole."""
    out = tokens.max_length_articles(table(spark, sf_dir, "documents"), 300, title="lang", abstract="source")
    count = lambda c, value: F.size(F.filter(c, lambda x: x == value))
    return out.select("doc_id", F.size("labels").alias("n"), count("attention_mask", 1).alias("n_real"), count("input_ids", F.lit("<pad>")).alias("n_pad"))


@query("SELECT doc_id, lang FROM documents WHERE lang = 'en' AND source = 'src1' ORDER BY doc_id LIMIT 20")
def first_of_subset(spark, sf_dir):
    """The first rows of a named subset."""
    return rows.first_rows(readers.subset(table(spark, sf_dir, "documents"), lang="en", source="src1").select("doc_id", "lang"), "doc_id", 20)


@query("SELECT conv_id, turn, CASE WHEN length(role) > 3 THEN role[1:3] || '...' ELSE role END AS role FROM conversations UNION ALL SELECT conv_id, turn, role FROM conversations WHERE role = 'user'")
def shown_records(spark, sf_dir):
    """All records to look at, their texts cut, and a union of tables."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return readers.union_all([readers.first_records(c, None, 3), c.where("role = 'user'")])


#: Orders as if placed in the month of the events, with a time of their own, and held open for as many minutes as they cost hundreds.
_PLACED = "o AS (SELECT o_orderkey, o_custkey AS user_id, TIMESTAMP '2024-01-01' + to_seconds((o_orderkey * 7919) % 2592000) AS placed, TIMESTAMP '2024-01-01' + to_seconds((o_orderkey * 7919) % 2592000 + (o_totalprice // 100)::BIGINT * 60) AS closed, o_totalprice FROM orders)"


def placed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = (F.col("o_orderkey") * 7919) % 2592000
    at = lambda s: F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + s)
    minutes = F.rint(F.col("o_totalprice") / 100).cast("bigint")  # as the SQL's cast does, half to even: its // of doubles keeps the fraction
    return table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), at(seconds).alias("placed"), at(seconds + minutes * 60).alias("closed"), "o_totalprice")


@query(f"WITH {_PLACED}, j AS (SELECT e.event_id, o.o_orderkey, o.o_totalprice, row_number() OVER (PARTITION BY e.event_id ORDER BY o.placed DESC, o.o_orderkey DESC) AS r FROM events e LEFT JOIN o ON o.user_id = e.user_id AND o.placed <= e.ts) SELECT event_id, o_orderkey, o_totalprice FROM j WHERE r = 1")
def events_last_order(spark, sf_dir):
    """Each event with the last order of its user before it."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return joins.asof_join(e, placed_orders(spark, sf_dir), ["user_id"], "ts", "placed", tie=["o_orderkey"]).select("event_id", "o_orderkey", "o_totalprice")


@query("WITH c AS (SELECT event_id AS click_id, user_id, ts AS clicked FROM events WHERE event_type = 'click'), j AS (SELECT e.event_id, c.click_id, row_number() OVER (PARTITION BY e.event_id ORDER BY c.clicked, c.click_id DESC) AS r FROM events e JOIN c ON c.user_id = e.user_id AND c.clicked > e.ts AND epoch_us(c.clicked) - epoch_us(e.ts) <= 86400000000 WHERE e.event_type = 'view') SELECT e.event_id, j.click_id FROM events e LEFT JOIN j ON j.event_id = e.event_id AND j.r = 1 WHERE e.event_type = 'view'")
def views_next_click(spark, sf_dir):
    """Each view with the first later click of its user, if that is within a day."""
    e = table(spark, sf_dir, "events")
    clicks = e.where("event_type = 'click'").select(F.col("event_id").alias("click_id"), "user_id", F.col("ts").alias("clicked"))
    views = e.where("event_type = 'view'").select("event_id", "user_id", "ts")
    return joins.asof_join(views, clicks, ["user_id"], "ts", "clicked", "forward", exact=False, tolerance=86_400_000_000, tie=["click_id"]).select("event_id", "click_id")


@query(f"WITH {_PLACED} SELECT e.event_id, o.o_orderkey FROM events e LEFT JOIN o ON o.user_id = e.user_id AND o.placed <= e.ts AND e.ts < o.closed")
def events_in_orders(spark, sf_dir):
    """Each event with the orders of its user that are open then."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return joins.interval_join(e, placed_orders(spark, sf_dir), ["user_id"], "ts", "placed", "closed", "left").select("event_id", "o_orderkey")


@query(f"WITH {_PLACED} SELECT a.o_orderkey AS first_key, b.o_orderkey AS second_key FROM o a JOIN o b ON a.user_id = b.user_id AND a.o_orderkey < b.o_orderkey AND a.placed < b.closed AND b.placed < a.closed AND a.placed < a.closed AND b.placed < b.closed")
def overlapping_orders(spark, sf_dir):
    """Pairs of a user's orders that are open at the same time."""
    a = placed_orders(spark, sf_dir).select("user_id", F.col("o_orderkey").alias("first_key"), F.col("placed").alias("p1"), F.col("closed").alias("c1"))
    b = placed_orders(spark, sf_dir).select("user_id", F.col("o_orderkey").alias("second_key"), F.col("placed").alias("p2"), F.col("closed").alias("c2"))
    return joins.overlap_join(a, b, ["user_id"], ("p1", "c1"), ("p2", "c2")).where("first_key < second_key").select("first_key", "second_key")


#: Which events come late, every 50th; of the others, which are never late, the SQL needs no more than that they come before.
_ARRIVAL = "CASE WHEN event_id % 50 = 0 AND event_id < n THEN 11 WHEN event_id = n THEN 8 ELSE event_id * 8 // (n + 1) END"
_LATE = f"t AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS us, {_ARRIVAL} AS batch FROM events, (SELECT max(event_id) AS n FROM events)), m AS (SELECT max(us) // 1000 * 1000 - 86400000000 AS mark FROM t WHERE batch < 11)"


def arriving_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of the events: in eight batches in the order of their times, whatever their ids are, but every 50th at the very end, after two batches with the last time (these rows aren't ``real``)."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    us, n = F.unix_micros(F.col("ts").cast("timestamp")), e.agg(F.max("event_id")).first()[0] or 0
    late = (F.col("event_id") % 50 == 0) & (F.col("event_id") < n)
    first, last = e.where(~late).agg(F.min(us), F.max(us)).first()
    first, last = first or 0, last or 0
    batch = F.when(late, 11).otherwise(F.coalesce(F.floor((us - first) / F.lit((last - first) / 8 + 1)), F.lit(0))).cast("int")
    more = spark.range(9, 11).select(
        F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("long").alias("user_id"), F.lit(None).cast("string").alias("event_type"),
        F.timestamp_micros(F.lit(last)).cast(e.schema["ts"].dataType).alias("ts"), F.col("id").cast("int").alias("arrival"), F.lit(False).alias("real"),
    )
    return event_streams.arrivals(readers.union_all([e.withColumn("arrival", batch).withColumn("real", F.lit(True)), more]), F.col("arrival")).drop("arrival")


@query(f"""WITH {_LATE}, w AS (SELECT event_type, batch, us, unnest([us // 21600000000 * 21600000000 - k * 21600000000 for k in [0, 1, 2, 3]]) AS start_us FROM t)
SELECT start_us, event_type, count(*) FILTER (WHERE batch < 11 OR start_us + 86400000000 > mark) AS n, count(*) FILTER (WHERE batch = 11 AND start_us + 86400000000 <= mark) AS n_late FROM w, m GROUP BY ALL""")
def event_windows(spark, sf_dir):
    """Windows of a day every six hours, by type, over a stream whose last batch is late for most of them."""
    output, checkpoint = event_streams.run_folder(spark)
    event_streams.stream_windows(arriving_events(spark, sf_dir), output, checkpoint, "ts", "1 day", "6 hours", "1 day", ["event_type", "real"])
    found = event_streams.current_windows(spark, output, ["event_type", "real"]).where("real")
    return found.select(F.unix_micros("start").alias("start_us"), "event_type", "n", "n_late")


@query(f"""WITH {_LATE}, o AS (SELECT user_id, us FROM t, m WHERE batch < 11 OR us + 21600000000 > mark),
g AS (SELECT user_id, us, sum(coalesce(us - before > 21600000000, false)::INT) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT user_id, us, lag(us) OVER (PARTITION BY user_id ORDER BY us) AS before FROM o)),
s AS (SELECT user_id, min(us) AS start_us, max(us) + 21600000000 AS end_us, count(*) AS n FROM g GROUP BY user_id, k)
SELECT user_id, start_us, end_us, n FROM s, m WHERE end_us <= mark""")
def event_sessions(spark, sf_dir):
    """The users' sessions that are over, by gaps of six hours; events that come too late for a session are in none."""
    output, checkpoint = event_streams.run_folder(spark)
    event_streams.stream_sessions(arriving_events(spark, sf_dir).where("real"), output, checkpoint, "ts", "6 hours", "1 day", ["user_id"])
    found = event_streams.current_sessions(spark, output, checkpoint, {"user_id": "long"})
    return found.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query(f"""WITH t AS (SELECT source, doc_id, doc_id % 3 AS shard, unnest(list_concat(['<eos>'], {_WORDS})) AS t, unnest(range(0, len({_WORDS}) + 1)) AS k FROM documents),
o AS (SELECT source, shard, t, row_number() OVER (PARTITION BY source, shard ORDER BY doc_id, k) - 1 AS i FROM t),
p AS (SELECT source, shard, i // 512 AS seq_id, string_agg(t, ' ' ORDER BY i) AS tokens, count(*) AS n FROM o GROUP BY ALL)
SELECT source, shard, seq_id, md5(tokens) AS tokens_md5 FROM p WHERE n = 512""")
def source_sequences(spark, sf_dir):
    """Sequences of each source, packed from a stream of documents by one buffer for each source and shard."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text", (F.col("doc_id") % 3).alias("shard"))
    n = docs.agg(F.max("doc_id")).first()[0] or 0
    folder, (output, checkpoint) = new_folder(spark, "arrivals"), event_streams.run_folder(spark)
    for k in range(4):  # a quarter of the ids at a time, by as many tasks as read them
        docs.where(F.floor(F.col("doc_id") * 4 / (n + 1)) == k).write.parquet(f"{folder}/part={k}")
        event_streams.stream_pack_by(spark.readStream.schema(docs.schema).parquet(folder), ["source", "shard"], output, checkpoint, 512, ["doc_id"])
    packed = spark.read.schema("source string, shard long, seq_id long, input_ids array<string>").parquet(output)
    return packed.select("source", "shard", "seq_id", F.md5(F.array_join("input_ids", " ").cast("binary")).alias("tokens_md5"))


@query("SELECT doc_id, lang, quality FROM (SELECT doc_id, lang, quality, row_number() OVER (PARTITION BY lang, quality ORDER BY md5('42:' || doc_id)) AS r FROM documents LEFT JOIN labels USING (doc_id)) WHERE r <= 20")
def stratified_sample(spark, sf_dir):
    """Twenty documents of each language and quality, without sorting a group."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return samples.stratified(d, ["lang", "quality"], 20, ["doc_id"])


@query()
def language_of_documents(spark, sf_dir):
    """Each document's language by profiles from a sample of those whose id's checksum isn't 1 modulo 3, and whether it was held out."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1)
    found = language.identify(docs, language.learn(docs.where(~F.col("held_out"))), keep=["doc_id", "lang", "held_out"])
    return found.select("doc_id", "lang", "held_out", "language")


@query("SELECT doc_id, lang, source, length(text) AS n FROM documents")
def arrow_documents(spark, sf_dir):
    """Documents written as Arrow files and read again, three columns of them and the texts' lengths."""
    folder = new_folder(spark, "arrow")
    arrow.write_arrow(table(spark, sf_dir, "documents"), folder)
    return readers.arrow_folder(spark, folder, columns=["doc_id", "lang", "source", "text"]).select("doc_id", "lang", "source", F.length("text").cast("bigint").alias("n"))


@query("WITH k AS (SELECT DISTINCT unnest(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS keyword FROM benchmark) SELECT doc_id, count(*) AS n, max(keyword) AS last FROM documents JOIN k ON contains(lower(text), lower(keyword)) GROUP BY doc_id")
def benchmark_keywords(spark, sf_dir):
    """Of each document how many words of the benchmark its text holds, and the last of them."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(text_functions.words(F.col("text"))).alias("keyword"))
    found = keywords.keyword_matches(table(spark, sf_dir, "documents"), words)
    return found.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("keyword").alias("last"))


@cache
def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _REGISTERED.items()}


@cache
def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _REGISTERED.items() if sql is not None}
