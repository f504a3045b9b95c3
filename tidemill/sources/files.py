"""Line-oriented files as DataFrames: JSON lines, coverage records, manifests of dependencies, URL lists, HTML folders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no from 1, line) of text files. Whole files are read so that lines keep their numbers."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def json_lines(lines: DataFrame, schema: T.StructType | str, line: str = "line") -> DataFrame:
    """The records of the lines that are JSON objects; all other lines are left out."""
    text = F.trim(F.col(line))
    parsed = lines.where(text.startswith("{")).withColumn("_v", F.try_parse_json(text)).where("_v IS NOT NULL")
    return parsed.select(*[c for c in lines.columns if c != line], F.from_json(text, schema).alias("_r")).select(*[c for c in lines.columns if c != line], "_r.*")


def scan_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return json_lines(spark.read.text(path).withColumnRenamed("value", "line"), schema)


def carried(value: Column, by: Sequence[str], order: str) -> Column:
    """The last value that isn't null, down the lines."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def coverage(lines: DataFrame) -> DataFrame:
    """(source, hit, found) from the coverage records SF:, DA:line,count, end_of_record in lines (file, line_no, line);
    records of one source add up."""
    mark = F.when(F.startswith("line", F.lit("SF:")), F.substring("line", 4, 1 << 20)).when(F.trim("line") == "end_of_record", F.lit(""))
    rows = lines.withColumn("source", carried(mark, ["file"], "line_no")).where(F.startswith("line", F.lit("DA:")) & (F.col("source") != ""))
    count = F.regexp_extract("line", r"^DA:[0-9]+,([0-9]+)", 1).try_cast("long")
    return rows.groupBy("source").agg(F.count_if(count > 0).alias("hit"), F.count("*").alias("found"))


def coverage_gate(cover: DataFrame, files: DataFrame, least: float = 90.0) -> DataFrame:
    """Each asked-for file with its hit, found and percentage (100 where nothing is to be hit), the sums over all, and
    whether the gate passes: every file has data and the whole is at least `least` percent. files: file, a short list."""
    joined = cover.join(F.broadcast(files), (F.col("source") == F.col("file")) | F.endswith("source", F.concat(F.lit("/"), F.col("file"))))
    best = joined.groupBy("file").agg(F.min(F.struct("source", "hit", "found")).alias("m"))
    rows = files.join(best, "file", "left").select("file", "m.hit", "m.found")
    percent = lambda hit, found: F.when(found > 0, 100.0 * hit / found).when(found == 0, 100.0)
    all_ = Window.partitionBy()
    total_hit, total_found = F.coalesce(F.sum("hit").over(all_), F.lit(0)), F.coalesce(F.sum("found").over(all_), F.lit(0))
    overall = F.when(total_found > 0, 100.0 * total_hit / total_found).otherwise(100.0)
    passed = (overall >= least) & (F.count_if(F.col("hit").isNull()).over(all_) == 0)
    return rows.select("file", "hit", "found", percent(F.col("hit"), F.col("found")).alias("percent"), overall.alias("overall"), passed.alias("passed"))


def dependencies(lines: DataFrame) -> DataFrame:
    """(file, name): the distinct keys of [dependencies] and names of [dependencies.name] in lines of TOML files."""
    header = F.regexp_extract("line", r"^\s*\[([^\[\]]+)\]\s*(#.*)?$", 1)
    rows = lines.withColumn("_h", F.when(header != "", F.trim(header)))
    rows = rows.withColumn("section", carried(F.col("_h"), ["file"], "line_no"))
    key = F.regexp_extract("line", r"""^\s*("?[A-Za-z0-9_-]+"?)\s*(\.|=)""", 1)
    name = F.when(F.startswith("_h", F.lit("dependencies.")), F.expr("substring(_h, 14)")).when(F.col("_h").isNull() & (F.col("section") == "dependencies") & (key != ""), F.btrim(key, F.lit('"')))
    return rows.select("file", name.alias("name")).where("name IS NOT NULL").distinct()


def url_list(lines: DataFrame, categories: Sequence[str]) -> DataFrame:
    """(file, line_no, url, category, problem): the entries `URL [category]` of a list; whole-line comments and empty
    lines are left out, a bad line has a problem and no url."""
    parts = F.split(F.trim(F.col("line")), r"\s+")
    rows = lines.withColumn("_p", parts).where((F.trim("line") != "") & ~F.startswith(F.trim("line"), F.lit("#")))
    second = F.try_element_at("_p", F.lit(2))
    known = second.isNull() | F.lower(second).isin(*categories)
    problem = F.when(F.size("_p") > 2, F.concat(F.lit("line "), F.col("line_no"), F.lit(": expected 'URL [category]', got "), F.size("_p"), F.lit(" fields"))).when(
        ~known, F.concat(F.lit("line "), F.col("line_no"), F.lit(": unknown category '"), second, F.lit(f"' (use one of {', '.join(categories)})"))
    )
    ok = problem.isNull()
    return rows.select("file", "line_no", F.when(ok, F.element_at("_p", 1)).alias("url"), F.when(ok, F.lower(second)).alias("category"), problem.alias("problem"))


def list_problems(entries: DataFrame, want: int, required: Sequence[str]) -> DataFrame:
    """(problem) of a list of entries (line_no, url, category): each must be https with a public name, without user
    info, once; `want` of them; every required category there."""
    at = lambda text: F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(f": {text}"))
    host = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    web = F.col("url").rlike("^(?i)https?://") & (host != "")
    literal = host.rlike(r"^(\[.*\]|[0-9]{1,3}(\.[0-9]{1,3}){3})$")
    again = F.row_number().over(Window.partitionBy("url").orderBy("line_no")) > 1
    rows = entries.withColumn("_again", again)
    found = rows.select(
        F.explode(
            F.array_compact(
                F.when(~web, F.array(at("not an absolute http(s) URL")))
                .when(literal, F.array(at("IP-literal host")))
                .otherwise(
                    F.array(
                        F.when(F.col("url").rlike(r"^[^/]*//[^/?#]*@"), at("URL has userinfo")),
                        F.when(F.col("_again"), at("duplicate URL")),
                        F.when(~F.col("url").rlike("^(?i)https:"), at("must be https")),
                    )
                )
            )
        ).alias("problem")
    )
    whole = entries.agg(F.count("*").alias("n"), F.collect_set("category").alias("c"))
    missing = F.array_except(F.lit(list(required)), F.col("c"))
    whole = whole.select(
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("n") != want, F.concat(F.lit("the list has "), F.col("n"), F.lit(f" URLs; exactly {want} are needed"))),
                    F.when(F.size(missing) > 0, F.concat(F.lit("no URL is tagged with category "), F.array_join(missing, ", "))),
                )
            )
        ).alias("problem")
    )
    return found.unionByName(whole)


def html_folder(spark: SparkSession, path: str) -> DataFrame:
    """(name, html) of the *.html files of a folder."""
    return spark.read.text(path, wholetext=True, pathGlobFilter="*.html").select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), F.col("value").alias("html"))


def manifest(rows: DataFrame, name: str, content: str) -> DataFrame:
    """(name, line): `sha256  name`, to be written in the order of names."""
    return rows.select(F.col(name).alias("name"), F.concat(F.sha2(F.col(content).cast("binary"), 256), F.lit("  "), F.col(name).cast("string")).alias("line"))


def verify_manifest(files: DataFrame, expected: DataFrame) -> DataFrame:
    """(name, ok): files (name, content binary) against expected (name, size, sha256)."""
    j = expected.join(files, "name", "left")
    good = (F.octet_length("content") == F.col("size")) & (F.sha2("content", 256) == F.col("sha256"))
    return j.select("name", F.coalesce(good, F.lit(False)).alias("ok"))


def markdown_table(rows: DataFrame, order: Sequence[str]) -> str:
    """A small result as a markdown table: a report's end, where the driver gets it anyway."""
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    lines += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows.orderBy(*order).collect()]
    return "\n".join(lines)
