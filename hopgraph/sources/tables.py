"""Readers and writers of node, pair, range, vector, walk, log and answer text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopgraph.plans.numbering import number_rows
from hopgraph.sources.lines import POS, checked, content, read_lines


def _num(tok, kind: str):
    return tok.try_cast(kind)


def _fields(lines: DataFrame, sep: str) -> DataFrame:
    trimmed = lines.withColumn("value", F.trim("value")).filter("value <> ''")
    return trimmed.withColumn("tok", F.split("value", sep))


# ------------------------------------------------------------------ node tables
def read_labels(spark: SparkSession, path: str, base: int = 1, mode: str = "strict") -> DataFrame:
    """``node,label`` lines, ids from ``base``; the last line of a node wins."""
    rows = _fields(read_lines(spark, path), ",")
    node, label = _num(F.get("tok", F.lit(0)), "bigint"), _num(F.get("tok", F.lit(1)), "int")
    ok = (F.size("tok") == 2) & node.isNotNull() & label.isNotNull()
    good = checked(rows, ok, mode).select((node - base).alias("id"), label.alias("label"), F.struct(*POS).alias("at"))
    return good.groupBy("id").agg(F.max_by("label", "at").alias("label"))


def read_scores(spark: SparkSession, path: str, mode: str = "strict") -> DataFrame:
    """``id-value`` lines; a negative value or exponent keeps its sign."""
    rows = read_lines(spark, path).withColumn("value", F.trim("value")).filter("value <> ''")
    rows = rows.withColumn("tok", F.split("value", "-", 2))
    node, score = _num(F.get("tok", F.lit(0)), "bigint"), _num(F.get("tok", F.lit(1)), "double")
    return checked(rows, node.isNotNull() & score.isNotNull(), mode).select(node.alias("id"), score.alias("score"))


def require_one_per_node(scores: DataFrame, nodes: DataFrame) -> DataFrame:
    """Fail unless every node has exactly one score."""
    bad = nodes.select("id").distinct().join(scores.groupBy("id").count(), "id", "full_outer").filter(
        F.coalesce("count", F.lit(0)) != 1
    )
    unknown = scores.join(nodes.select("id"), "id", "left_anti")
    if not bad.isEmpty() or not unknown.isEmpty():
        raise ValueError("scores and nodes differ")
    return scores


def read_positional_scores(spark: SparkSession, path: str) -> DataFrame:
    """Bare values, row number = id, divided by their sum."""
    rows = read_lines(spark, path).withColumn("value", F.trim("value")).filter("value <> ''")
    numbered = number_rows(rows, *POS, name="id").select("id", F.col("value").cast("double").alias("score"))
    return numbered.select("id", (F.col("score") / numbered.agg(F.sum("score")).scalar()).alias("score"))


def merge_scores(parts: DataFrame) -> DataFrame:
    """Add up partial scores."""
    return parts.groupBy("id").agg(F.sum("score").alias("score"))


def write_scores(scores: DataFrame, path: str) -> None:
    scores.select(F.concat_ws("-", "id", "score")).write.mode("overwrite").text(path)


# ------------------------------------------------------------- pairs and ranges
_ID = r"^\s*(?:tensor\()?\s*(\d+)\s*\)?\s*$"


def read_pairs(spark: SparkSession, path: str, mode: str = "strict") -> DataFrame:
    """``src,dst,dist`` lines, ids also as ``tensor(5)``."""
    rows = _fields(read_lines(spark, path), ",")

    def ident(i):
        return F.regexp_extract(F.get("tok", F.lit(i)), _ID, 1).try_cast("bigint")

    src, dst = ident(0), ident(1)
    d = F.regexp_extract(F.get("tok", F.lit(2)), r"^\s*(?:tensor\()?\s*(-?[\d.]+(?:[eE][-+]?\d+)?)\s*\)?\s*$", 1).try_cast("double")
    ok = (F.size("tok") == 3) & src.isNotNull() & dst.isNotNull() & d.isNotNull()
    return checked(rows, ok, mode).select(src.alias("src"), dst.alias("dst"), d.alias("d"))


def write_pairs(pairs: DataFrame, path: str) -> None:
    pairs.select("src", "dst", F.col("d").cast("double")).write.mode("overwrite").csv(path)


def normalise_pairs(spark: SparkSession, path: str, out: str) -> None:
    """Rewrite a pair file in clean form."""
    write_pairs(read_pairs(spark, path), out)


def write_ranges(ranges: DataFrame, path: str) -> None:
    """``src,dst,a&b&d@a&b&d@``."""
    cells = F.transform("rng", lambda r: F.concat_ws("&", r["a"], r["b"], r["d"]))
    text = F.concat(F.concat_ws(",", "src", "dst"), F.lit(","), F.array_join(cells, "@"), F.lit("@"))
    ranges.select(text).write.mode("overwrite").text(path)


def read_ranges(spark: SparkSession, path: str) -> DataFrame:
    """Back to ``(src, dst, rng array<struct<a,b,d>>)``."""
    rows = _fields(read_lines(spark, path), ",")
    cells = F.filter(F.split(F.get("tok", F.lit(2)), "@"), lambda c: c != "")

    def cell(c):
        p = F.split(c, "&")
        return F.struct(
            F.get(p, F.lit(0)).cast("bigint").alias("a"),
            F.get(p, F.lit(1)).cast("bigint").alias("b"),
            F.get(p, F.lit(2)).cast("int").alias("d"),
        )

    return rows.select(
        F.get("tok", F.lit(0)).cast("bigint").alias("src"),
        F.get("tok", F.lit(1)).cast("bigint").alias("dst"),
        F.transform(cells, cell).alias("rng"),
    )


# ------------------------------------------------------------------- embeddings
def read_embedding(spark: SparkSession, path: str, form: str = "header", sep: str = " ") -> DataFrame:
    """``(id, v)``.

    ``header`` word2vec text whose first line (two tokens) is dropped; ``rows``
    a bare matrix, row number = id; ``csv`` leading id, comma separated.
    """
    if form == "csv":
        rows = _fields(read_lines(spark, path), ",")
    else:
        rows = content(read_lines(spark, path))
    if form == "rows":
        numbered = number_rows(rows, *POS, name="id")
        return numbered.select("id", F.transform("tok", lambda x: x.cast("double")).alias("v"))
    if form == "header":
        rows = rows.filter(F.size("tok") > 2)
    body = F.slice("tok", 2, F.size("tok"))
    return rows.select(F.get("tok", F.lit(0)).cast("bigint").alias("id"), F.transform(body, lambda x: x.cast("double")).alias("v"))


def write_embedding(emb: DataFrame, path: str) -> None:
    """word2vec text, the header line in a part of its own, so the rows stay distributed."""
    head = emb.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).select(F.concat_ws(" ", "n", "d").alias("value"))
    text = F.concat(F.col("id").cast("string"), F.lit(" "), F.array_join(F.transform("v", lambda x: x.cast("string")), " "))
    head.coalesce(1).write.mode("overwrite").text(path)
    emb.select(text.alias("value")).write.mode("append").text(path)


# --------------------------------------------------------- walks, logs, results
def write_walks(walks: DataFrame, path: str) -> None:
    """One walk per line."""
    walks.select(F.array_join(F.transform("path", lambda x: x.cast("string")), " ")).write.mode("overwrite").text(path)


def read_walks(spark: SparkSession, path: str) -> DataFrame:
    rows = content(read_lines(spark, path)).select(F.transform("tok", lambda x: x.cast("bigint")).alias("path"), *POS)
    return number_rows(rows, *POS, name="wid").select(
        F.get("path", F.lit(0)).alias("root"), F.col("wid"), "path"
    )


def read_train_log(spark: SparkSession, path: str) -> DataFrame:
    """``epoch,train[,val]`` -> ``(run, epoch, train, val)``, run = file name."""
    rows = _fields(read_lines(spark, path), ",")
    return rows.select(
        F.regexp_extract("file", r"([^/]+)$", 1).alias("run"),
        F.get("tok", F.lit(0)).cast("int").alias("epoch"),
        F.get("tok", F.lit(1)).cast("double").alias("train"),
        F.get("tok", F.lit(2)).try_cast("double").alias("val"),
    )


def write_train_log(log: DataFrame, path: str) -> None:
    log.select(F.concat_ws(",", "epoch", "train", "val")).write.mode("overwrite").text(path)


def write_matrix(long: DataFrame, path: str, row: str, col: str, value: str, columns: list) -> None:
    """Long results as a CSV matrix."""
    long.groupBy(row).pivot(col, columns).agg(F.first(value)).orderBy(row).coalesce(1).write.mode("overwrite").csv(path, header=True)


def answer_lines(answers: DataFrame) -> DataFrame:
    """``src#d1-d2-...`` per source followed by ``src-dst-dist`` rows, as ``(src, ord, value)``.

    The list of destinations belongs to one query of the caller, who states its size.
    """
    heads = answers.groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("all")).select(
        "src", F.lit(-1).cast("bigint").alias("ord"),
        F.concat(F.col("src").cast("string"), F.lit("#"), F.array_join(F.transform("all", lambda x: x.cast("string")), "-")).alias("value"),
    )
    rows = answers.select("src", F.col("dst").alias("ord"), F.concat_ws("-", "src", "dst", "d").alias("value"))
    return heads.union(rows)


def write_answers(answers: DataFrame, path: str) -> None:
    answer_lines(answers).orderBy("src", "ord").select("value").write.mode("overwrite").text(path)


def path_lines(paths: DataFrame) -> DataFrame:
    """``a-b-c`` per path."""
    return paths.select(F.array_join(F.transform("path", lambda x: x.cast("string")), "-").alias("value"))


def edge_lines(edges: DataFrame) -> DataFrame:
    return edges.select(F.concat_ws("-", "src", "dst").alias("value"))
