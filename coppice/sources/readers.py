"""Reading and writing the file formats of the corpora: Parquet trees, JSON lines, text, source files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from coppice.operators.ranking import ranked

#: The schemas of the inputs, as DDL.
TREE_CORPUS = "tokens array<int>, parents array<int>, descendants array<int>, hashes array<bigint>, language string, repository string, path string"
SNIPPETS = "problem string, problem_description string, method_masked string, target string, context_masked string, file string, mask_start int, mask_end int, method_start int, method_end int, context_start int, context_end int"
DISTRACTORS = "language string, code_sampled_span string, repo string, path string, sha string, url string, docstring string, code_full string, code_body string"
DEFECTS = "func string, target int"
CLONES = "label string, index string, code string"

def tree_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """A corpus of trees: one Parquet dataset, or a folder of several."""
    return spark.read.schema(TREE_CORPUS).option("recursiveFileLookup", True).parquet(folder)

def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with an explicit schema; a line that is no JSON gives a row of nulls."""
    return spark.read.schema(schema).json(path)

def row_numbers(df: DataFrame, name: str = "query_id") -> DataFrame:
    """Numbers from 0 in the order of the files: positions within partitions plus what lies before.

    Two passes, no global sort: the counts of the partitions are few numbers."""
    tagged = df.withColumn("__id", F.monotonically_increasing_id())
    part, at = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = tagged.groupBy(part.alias("__p")).agg((F.max(at) + 1).alias("__n"))
    before = sizes.select("__p", (F.sum("__n").over(W.orderBy("__p")) - F.col("__n")).alias("__b"))
    return tagged.withColumn("__p", part).withColumn("__at", at).join(F.broadcast(before), "__p").withColumn(name, F.col("__b") + F.col("__at")).drop("__id", "__p", "__at", "__b")

def snippets(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Queries, targets and problems of an evaluation file.

    ``queries`` and ``targets``: ``query_id, label, code`` and the problem; ``problems``: ``label,
    problem, problem_description``. Labels count the sorted problems from 1; 0 is for distractors."""
    rows = row_numbers(json_lines(spark, path, SNIPPETS))
    problems = rows.groupBy("problem").agg(F.min("problem_description").alias("problem_description"))
    problems = problems.join(ranked(problems, "problem", "label"), "problem")
    labelled = rows.join(problems.select("problem", "label"), "problem")
    one = lambda column: labelled.select("query_id", "label", "problem", F.col(column).alias("code"))
    return one("method_masked"), one("target"), problems.select("label", "problem", "problem_description")

def distractors(spark: SparkSession, path: str, most: int = 0) -> DataFrame:
    """``query_id`` -1, ``label`` 0, ``language, code``; with ``most``, the first rows of the file."""
    rows = json_lines(spark, path, DISTRACTORS)
    rows = row_numbers(rows, "row").orderBy("row").limit(most) if most else rows
    return rows.select(F.lit(-1).cast("long").alias("query_id"), F.lit(0).alias("label"), "language", F.col("code_sampled_span").alias("code"))

def splits(spark: SparkSession, paths: dict[str, str], schema: str) -> DataFrame:
    """Several split files as one table with a ``split`` column."""
    out = None
    for split, path in paths.items():
        one = json_lines(spark, path, schema).withColumn("split", F.lit(split))
        out = one if out is None else out.unionByName(one)
    return out

def split_by_position(spark: SparkSession, functions: str, id_files: dict[str, str]) -> DataFrame:
    """One JSON array of functions, split by files that list positions: ``func, target, idx, split``."""
    rows = row_numbers(spark.read.schema(DEFECTS).option("multiLine", True).json(functions), "idx")
    out = None
    for split, path in id_files.items():
        ids = spark.read.text(path).select(F.expr("try_cast(trim(value) as bigint)").alias("idx")).where("idx is not null")
        one = rows.join(ids, "idx", "left_semi").select("func", "target", "idx", F.lit(split).alias("split"))
        out = one if out is None else out.unionByName(one)
    return out

def text_of(content):
    """Bytes as text: UTF-8 where they are that, else Latin-1."""
    return F.coalesce(F.expr("try_validate_utf8(cast({} as string))".format(content)), F.decode(F.col(content), "ISO-8859-1"))

def source_files(spark: SparkSession, folder: str) -> DataFrame:
    """``path, code`` of every file below a folder."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return raw.select("path", text_of("content").alias("code"))

def labelled_folders(spark: SparkSession, folder: str) -> DataFrame:
    """``label, index, code, split`` of program files in folders named by their label: up to 64 train, up
    to 80 valid, up to 194 test. Texts are Latin-1; indexes count the paths from 0."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    label = F.element_at(F.split("path", "/"), -2)
    rows = raw.select("path", label.alias("label"), F.decode("content", "ISO-8859-1").alias("code"))
    rows = row_numbers(rows.repartitionByRange("path").sortWithinPartitions("path"), "index")
    n = F.expr("try_cast(label as int)")
    split = F.when(n.between(1, 64), "train").when(n.between(65, 80), "valid").when(n.between(81, 194), "test")
    return rows.select("label", F.col("index").cast("string").alias("index"), "code", split.alias("split")).where("split is not null")

def line_count(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()

def word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """``word, vector`` of a text file of word vectors; its header (two numbers) is skipped."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(parts.alias("p")).where(F.size("p") > 2)
    return rows.select(F.col("p")[0].alias("word"), F.slice("p", F.lit(2), F.size("p") - 1).cast("array<double>").alias("vector"))

def vocabulary_overlap(vectors: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """One row: words with a vector, words of the vocabulary, words in both."""
    words, known = vectors.select("word").distinct(), vocabulary.select(F.col("token").alias("word")).distinct()
    both = words.join(known, "word").agg(F.count("*").alias("both"))
    return words.agg(F.count("*").alias("vectors")).crossJoin(known.agg(F.count("*").alias("tokens"))).crossJoin(both)

def from_heads(df: DataFrame, key: str) -> DataFrame:
    """Sentences with ``heads`` (position of each word's head, its own for the root) as trees:
    ``key, parents, order``, words in pre-order, ``order`` their positions."""
    from coppice.operators.trees import tree_map

    def build(heads):
        h = [int(x) for x in heads]
        roots = [i for i, x in enumerate(h) if x == i]
        if len(roots) != 1:
            return []
        kids: dict[int, list[int]] = {}
        for i, x in enumerate(h):
            if x != i:
                kids.setdefault(x, []).append(i)
        parents, order, stack = [], [], [(roots[0], -1)]
        while stack:
            node, up = stack.pop()
            parents.append(up)
            order.append(node)
            stack += [(k, len(order) - 1) for k in reversed(kids.get(node, []))]
        return [(parents, order)] if len(order) == len(h) else []

    return tree_map(df, [key], ["heads"], build, "parents array<int>, order array<int>")

def write_predictions(df: DataFrame, path: str) -> None:
    """JSON lines of predictions."""
    df.write.mode("overwrite").json(path)

def write_zipped(batches: DataFrame, columns: list[str], path: str, version: int, keep: int = 5) -> None:
    """Batches of equally long lists, a JSON line per position. Every version has a folder of its own, of
    which the last ``keep`` stay."""
    rows = batches.select(F.explode(F.arrays_zip(*columns)).alias("r")).select("r.*")
    rows.write.mode("overwrite").json(f"{path}/version={version}")
    context = batches.sparkSession.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(context._jsc.hadoopConfiguration())
    for status in system.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("version=") and int(name[8:]) <= version - keep:
            system.delete(status.getPath(), True)

def write_pages(pages: DataFrame, path: str) -> None:
    """Rendered pages, one text file folder a page."""
    pages.select("page", F.col("html").alias("value")).write.mode("overwrite").partitionBy("page").text(path)
