"""Sources and sinks. Schemas are explicit, each the union of the names that a field has had; nothing is inferred.

Files are read by Spark's readers, so any store that Spark knows will do; logs and JSON documents by those of ``documents``, for stores that pyarrow knows.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradeloom.functions import text as x
from gradeloom.operators.preparation import by_winner, preferred_pairs
from gradeloom.sources import documents

MESSAGES = "array<struct<role:string,content:string>>"
RUBRICS = "array<struct<criterion:string,points:int>>"
WEIGHTED_RUBRICS = "array<struct<criterion:string,criteria:string,weight:double,points:double>>"
# Schemas of the input layouts.
SYNTHETIC = f"source string, question string, gold_answer string, rubric {RUBRICS}, rubrics {RUBRICS}"
PROMPTS = f"prompt_id string, prompt {MESSAGES}, rubrics {RUBRICS}, ideal_completions_data struct<ideal_completion:string>"
META = f"prompt_id string, prompt {MESSAGES}, completion string, binary_labels array<boolean>, category string"
PER_PROMPT = "prompt_id string, category string, num_completions int, pairwise_acc double, resolution double, pairs_used double, pred_scores array<double>, label_scores array<double>"
STEP_CSV = "step int, reward double, reward_min double, reward_max double, n_crit double, n_uniq double, unique_ratio double"
USAGE = "modelName string, promptTokens bigint, completionTokens bigint, quota bigint, createdAt double"


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str, limit: int | None = None) -> DataFrame:
    """Rows of JSON lines files with their file in ``file`` and place in ``ord`` (rises with the line inside a file).

    Blank lines are skipped; lines that aren't JSON give rows of nulls, as do files without the fields.
    """
    df = spark.read.schema(schema).json(path).select("*", F.col("_metadata.file_name").alias("file"), F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("n")).alias("ord"))
    return df.orderBy("ord").limit(limit) if limit is not None else df


def read_synthetic(spark: SparkSession, path: str, source: str | None = None) -> DataFrame:
    """(source, question, gold_answer, rubric) under either name of the rubric field; rows without a question or rubric go."""
    df = read_jsonl(spark, path, SYNTHETIC)
    rubric = x.normalise_rubrics(F.coalesce("rubric", "rubrics"))
    name = F.lit(source) if source else F.coalesce("source", F.lit("synthetic"))
    out = df.select(name.alias("source"), F.trim(x.text_of("question")).alias("question"), x.text_of("gold_answer").alias("gold_answer"), rubric.alias("rubric"), "ord")
    return out.filter((F.col("question") != "") & (F.size("rubric") > 0))


def read_prompts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(prompt_id, question, rubrics, ideal_completion, source, ord) from evaluation files; source is the file."""
    df = read_jsonl(spark, paths, PROMPTS)
    question = x.chat_lines(F.col("prompt"))
    id_ = F.coalesce(F.nullif(F.trim(x.text_of("prompt_id")), F.lit("")), F.md5(question))
    out = df.select(id_.alias("prompt_id"), question.alias("question"), x.normalise_rubrics(F.col("rubrics")).alias("rubrics"), x.text_of("ideal_completions_data.ideal_completion").alias("ideal_completion"), F.col("file").alias("source"), "ord")
    return out.filter((F.col("question") != "") & (F.size("rubrics") > 0))


def rubric_tables(prompts: DataFrame, queries: DataFrame) -> DataFrame:
    """(source, question, rubric) from the two layouts of rubric tables: chats with points, and plain queries with weights."""
    a = prompts.select(F.col("data_source").alias("source"), x.chat_user_text(F.col("prompt")).alias("question"), x.normalise_rubrics(F.col("Rubrics")).alias("rubric"))
    a = a.withColumn("rubric", F.transform("rubric", lambda r: F.struct(r["criterion"], x.clamp_points(r["points"]).alias("points"))))
    item = lambda r: F.struct(F.trim(F.coalesce(r["criterion"], r["criteria"], F.lit(""))).alias("criterion"), x.weight_to_points(F.coalesce(r["weight"], r["points"])).alias("points"))
    b = queries.select("source", F.trim(x.text_of("query")).alias("question"), F.filter(F.transform("rubrics", item), lambda r: r["criterion"] != "").alias("rubric"))
    return a.unionByName(b)


def read_rubric_tables(spark: SparkSession, prompts: Sequence[str], queries: Sequence[str], kind: str = "parquet") -> DataFrame:
    """``rubric_tables`` of folders of the two layouts, Parquet or JSON lines."""
    a = spark.read.schema(f"prompt {MESSAGES}, Rubrics {RUBRICS}, data_source string").format(kind).load(list(prompts))
    b = spark.read.schema(f"query string, rubrics {WEIGHTED_RUBRICS}, source string").format(kind).load(list(queries))
    return rubric_tables(a, b)


def read_mixed(spark: SparkSession, paths: Sequence[str], schema: str) -> DataFrame:
    """Parquet and JSON files by their endings, one table; columns that a file lacks are null."""
    out = None
    for path in paths:
        kind = path.rstrip("/").rsplit(".", 1)[-1]
        if kind not in ("parquet", "json", "jsonl"):
            raise ValueError(f"can't read {path}: parquet, json or jsonl is expected")
        df = spark.read.parquet(path) if kind == "parquet" else spark.read.schema(schema).json(path)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def take_valid(df: DataFrame, valid: Column, needed: int) -> DataFrame:
    """The first ``needed`` rows found for which a condition holds; reading stops there."""
    return df.filter(valid).limit(needed)


# Schemas of the preference layouts, by name.
PREFERENCES = {
    "chosen": "prompt string, chosen string, rejected string, subset string",
    "winner": "prompt string, response_1 string, response_2 string, winner string",
    "conversation": f"conversation {MESSAGES}, responses array<struct<answer:string>>, preferred_index int, category_path string",
}


def read_preferences(spark: SparkSession, path: str, layout: str, a_name: str = "model_a", b_name: str = "model_b", kind: str = "json") -> DataFrame:
    """(prompt, chosen, rejected, subset) from one of the layouts, JSON lines or Parquet; rows without a usable preference go."""
    df = spark.read.schema(PREFERENCES[layout]).format(kind).load(path)
    if layout == "conversation":
        return preferred_pairs(df)
    if layout == "winner":
        df = by_winner(df, "response_1", "response_2", "winner", a_name, b_name).withColumn("subset", F.lit(None).cast("string"))
    return df.select("prompt", "chosen", "rejected", "subset")


def step_of(file: Column) -> Column:
    """The number behind ``step_`` or ``step=`` in a path."""
    return F.regexp_extract(file, r"step[_=](\d+)", 1).try_cast("int")


def read_steps(spark: SparkSession, path: str, schema: str, steps: Sequence[int] | None = None, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """Step logs with ``step`` from the name of the file or its folder; only files of the wanted steps give rows."""
    df = spark.read.schema(schema).json(path).withColumn("step", step_of(F.col("_metadata.file_path")))
    if steps is not None:
        df = df.filter(F.col("step").isin(list(steps)))
    if lo is not None:
        df = df.filter(F.col("step") >= lo)
    return df.filter(F.col("step") <= hi) if hi is not None else df


def read_log(spark: SparkSession, path: str, range_bytes: int = documents.RANGE_BYTES) -> DataFrame:
    """(log, line_no, line) of the lines of text logs that aren't blank; line_no is the line's place in its file, from 0.

    A log is read by ranges of bytes, each by a task of its own. A table with a row a range says how many lines stand before it; it is left out where no log has two.
    """
    rows = documents.read_lines(spark, path, range_bytes)
    log = F.element_at(F.split("path", "/"), -1).alias("log")
    if all(size <= range_bytes for _, size in documents.files_below(path)):
        return rows.filter(F.trim("line") != "").select(log, F.col("i").alias("line_no"), "line")
    ranges = rows.groupBy("path", "start").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.select("path", "start", F.coalesce(before, F.lit(0)).alias("_before"))
    return rows.filter(F.trim("line") != "").join(ranges, ["path", "start"]).select(log, (F.col("_before") + F.col("i")).alias("line_no"), "line")


def read_usage(spark: SparkSession, path: str, since: float | None = None) -> DataFrame:
    """(model, tokens_in, tokens_out, quota, created) from downloaded JSON lists of calls, read call by call."""
    df = documents.read_elements(spark, path).select(F.from_json("json", USAGE).alias("r")).select("r.*")
    out = df.select(F.col("modelName").alias("model"), F.col("promptTokens").alias("tokens_in"), F.col("completionTokens").alias("tokens_out"), "quota", F.timestamp_seconds(F.col("createdAt")).alias("created"), "createdAt")
    return (out if since is None else out.filter(F.col("createdAt") >= since)).drop("createdAt")


def read_step_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STEP_CSV).csv(path, header=True)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The per-prompt rows of ``{summary, per_prompt}`` documents, with their file. Documents are read prompt by prompt."""
    rows = documents.read_elements(spark, path, "per_prompt")
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.from_json("json", PER_PROMPT).alias("r")).select("file", "r.*")


def long_scores(results: DataFrame) -> DataFrame:
    """(prompt, ord, score, label) from the two parallel arrays of per-prompt rows."""
    zipped = F.arrays_zip(F.col("pred_scores"), F.col("label_scores"))
    return results.select(F.col("prompt_id").alias("prompt"), F.posexplode(zipped).alias("ord", "z")).select("prompt", "ord", F.col("z.pred_scores").alias("score"), F.col("z.label_scores").alias("label"))


def read_cache_document(spark: SparkSession, path: str) -> DataFrame:
    """(id, text) from JSON objects of texts by id, read member by member. An id that is there twice gives two rows; texts that are null stay null."""
    members = documents.read_elements(spark, path, "*")
    return members.select(F.col("name").alias("id"), F.get_json_object(F.concat(F.lit('{"v":'), "json", F.lit("}")), "$.v").alias("text"))


# ---- sinks


def training_rows(df: DataFrame, template: str = "{question}") -> DataFrame:
    """The nested layout of training rows from (source, question, gold_answer, rubric, prompt_id)."""
    prompt = F.array(F.struct(F.lit("user").alias("role"), x.fill_template(template, question=F.col("question")).alias("content")))
    gold_rubric = F.array_join(F.transform("rubric", lambda r: x.rubric_line(r["criterion"], r["points"])), "\n")
    truth = F.struct("question", "gold_answer", gold_rubric.alias("gold_rubric"))
    return df.select(prompt.alias("prompt"), F.lit("").alias("response"), "question", "gold_answer", F.col("source").alias("data_source"), F.struct(F.lit("rule").alias("style"), truth.alias("ground_truth")).alias("reward_model"), F.struct("question", "prompt_id").alias("extra_info"))


def write_parquet(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).parquet(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def nested_step_log(rows: DataFrame) -> DataFrame:
    """(step, question, n_rollouts, rollouts): a row a question with its rollouts in order, doubles rounded to 4 places."""
    values = [F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes if c not in ("step", "question")]
    return rows.groupBy("step", "question").agg(F.count(F.lit(1)).alias("n_rollouts"), F.sort_array(F.collect_list(F.struct("rollout", *[v for v, (c, _) in zip(values, [d for d in rows.dtypes if d[0] not in ("step", "question")], strict=True) if c != "rollout"]))).alias("rollouts"))


def write_steps(df: DataFrame, path: str, mode: str = "append") -> None:
    """One folder of JSON lines a step."""
    df.write.mode(mode).partitionBy("step").json(path)


def write_result(per_prompt: DataFrame, path: str, metrics: Sequence[str]) -> None:
    """The per-prompt table and its summary side by side."""
    per_prompt.write.mode("overwrite").json(f"{path}/per_prompt")
    summary = per_prompt.agg(F.count(F.lit(1)).alias("num_prompts"), *[F.avg(m).alias(m) for m in metrics])
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def wide_samples(samples: DataFrame, by: str, order: str, text: str) -> DataFrame:
    """(by, responses): the n samples of each row as one array in order."""
    return samples.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda s: s[text]).alias("responses"))


# ---- response cache


def cache_key(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def split_cached(work: DataFrame, cache: DataFrame, key: str = "cache_key") -> tuple[DataFrame, DataFrame]:
    """(rows with their cached response, rows to do). An empty response is no hit."""
    hits = cache.filter(F.col("response") != "").groupBy(key).agg(F.first("response").alias("response"))
    return work.join(hits, key), work.join(hits, key, "left_anti")


class ResponseCache:
    """Responses by key in a folder: a log of writes and deletes, of which the last for a key holds, and a compacted state of the log so far.

    Every ``put`` and ``delete`` appends rows with one number that rises from append to append (the clock of the one driver that writes), a delete without a response.
    ``compact`` writes what holds now, sorted by key and with Bloom filters of the keys in files that are dealt by key, and then names it in ``states``, so a run that is cut short leaves the
    state before it. Reading takes the last state named and the log behind it. Null keys are left out; of several responses in one append the largest holds.
    """

    LOG, STATES = "cache_key string, response string, seq long", "seq long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _append(self, rows: DataFrame) -> None:
        rows.filter("cache_key is not null").withColumn("seq", F.lit(time.time_ns())).write.mode("append").parquet(f"{self.path}/log")

    def put(self, rows: DataFrame) -> None:
        self._append(rows.groupBy("cache_key").agg(F.max("response").alias("response")))

    def delete(self, keys: DataFrame) -> None:
        self._append(keys.select("cache_key").distinct().withColumn("response", F.lit(None).cast("string")))

    def _read(self, name: str, schema: str) -> DataFrame:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        there = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if there else self.spark.createDataFrame([], schema)

    def table(self, upto: int | None = None) -> DataFrame:
        """(cache_key, response): what holds now."""
        state = self._read("states", self.STATES).agg(F.max("seq")).first()[0]
        log = self._read("log", self.LOG).filter(F.col("seq") > (state or 0))
        log = log if upto is None else log.filter(F.col("seq") <= upto)
        rows = log if state is None else log.unionByName(self._read(f"state-{state}", self.LOG))
        return rows.groupBy("cache_key").agg(F.max_by("response", "seq").alias("response")).filter("response is not null")

    def look_up(self, work: DataFrame) -> DataFrame:
        """The rows of ``work`` whose key has a response."""
        return work.join(self.table(), "cache_key")

    def compact(self, files: int = 16) -> None:
        upto = self._read("log", self.LOG).agg(F.max("seq")).first()[0]
        if upto is None:
            return
        rows = self.table(upto).withColumn("seq", F.lit(upto)).repartition(files, "cache_key").sortWithinPartitions("cache_key")
        rows.write.mode("overwrite").option("parquet.bloom.filter.enabled#cache_key", "true").parquet(f"{self.path}/state-{upto}")
        self.spark.createDataFrame([(upto,)], self.STATES).write.mode("append").parquet(f"{self.path}/states")


def load_or_compute(spark: SparkSession, path: str, compute, **parameters: object) -> DataFrame:
    """The table saved at ``path`` for these parameters, or else the computed one, saved there.

    A folder that a crash left without its success mark is computed again.
    """
    key = hashlib.md5(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()
    at = f"{path}/{key}" if parameters else path
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
    if not mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):
        compute().write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)
