"""JSON, CSV and Markdown output of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.operators.rows import key_values
from concord.operators.skew import expand
from concord.plans.run import Run, each_finding

# Sections of a document, in order, with their headings.
SECTIONS = {"schema": "Schema Differences", "profile": "Profile Differences", "volume": "Volume Parity", "rows": "Row-Level Differences"}
CSV_SECTIONS = {**SECTIONS, "volume": "Volume (Aggregate) Differences"}
# The head of a CSV document, the texts of a Markdown document.
CSV_HEAD = ["Section", "Comparison", "RunId", "Status"]
CSV_SUMMARY = "Summary"
MARKDOWN_TITLE, MARKDOWN_NONE = "# Parity Results: ", "_None._"
# Column titles per section, for CSV and for Markdown.
CSV_TITLES = {
    "schema": ["Severity", "ColumnName", "Kind", "SourceType", "TargetType", "Message"],
    "profile": ["Severity", "ColumnName", "Metric", "SourceValue", "TargetValue", "Message"],
    "volume": ["Severity", "SourceCount", "TargetCount", "Difference", "DifferenceRate", "Message"],
    "rows": ["Severity", "Category", "KeyValues", "Message", "ColumnDifferences"],
}
MARKDOWN_TITLES = {
    "schema": ["Severity", "Column", "Kind", "Source Type", "Target Type", "Message"],
    "profile": ["Severity", "Column", "Metric", "Source Value", "Target Value", "Message"],
    "volume": ["Severity", "Source Count", "Target Count", "Difference", "Difference Rate", "Message"],
    "rows": ["Severity", "Category", "Key Values", "Message", "Column Differences"],
}
FIELDS = {
    "schema": ["severity", "column_name", "kind", "source_type", "target_type", "message"],
    "profile": ["severity", "column_name", "metric", "source_value", "target_value", "message"],
    "volume": ["severity", "source_rows", "target_rows", "difference", "difference_rate", "message"],
}


def section_frames(run: Run) -> dict[str, DataFrame]:
    """The frames of the checks that ran; one row per finding."""
    frames = {name: getattr(run, name) for name in SECTIONS}
    present = {name: df for name, df in frames.items() if df is not None}
    if "rows" in present:
        present["rows"] = each_row_finding(present["rows"], list(run.keys))
    return present


def each_row_finding(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per finding: a duplicated key is listed once per row it has."""
    return rows.where("findings = 1").unionByName(expand(rows.where("findings > 1"), "findings", keys))


def _texts(name: str, df: DataFrame, keys: list[str], joiner: str) -> list[Column]:
    if name == "rows":
        known = lambda c: F.coalesce(c, F.lit("null"))
        key = F.array_join(key_values(df, keys), joiner, "null")
        change = lambda d: F.concat(d.column_name, F.lit(": "), known(d.source_value), F.lit(" -> "), known(d.target_value))  # noqa: E731,E501
        changes = F.array_join(F.transform("differences", change), "; ")
        return [F.col("severity"), F.col("category"), key, F.col("message"), changes]
    return [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in FIELDS[name]]


def csv_field(text: Column) -> Column:
    """Quote a field that holds a comma, a quote or a line break."""
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike(r'[",\n\r]'), quoted).otherwise(text)


def csv_lines(name: str, df: DataFrame, keys: list[str] = ()) -> DataFrame:
    """The lines of one section as text."""
    return df.select(F.concat_ws(",", *[csv_field(t) for t in _texts(name, df, list(keys), ";")]).alias("line"))


def csv_document(run: Run, run_id: str) -> DataFrame:
    """The whole document as (section, part, line); sorted by these it reads in order.

    A head with the run, then each section with its title and header, with a
    blank line between them. Values keep their spaces.
    """
    spark = run.findings.sparkSession
    schema = "section int, part int, line string"
    row = [csv_field(c) for c in (F.lit(CSV_SUMMARY), F.col("comparison"), F.lit(run_id), F.col("status"))]
    head = run.summary.select(F.lit(0).alias("section"), F.lit(1).alias("part"), F.concat_ws(",", *row).alias("line"))
    fixed = [(0, 0, ",".join(CSV_HEAD))]
    for section, (name, title) in enumerate(CSV_SECTIONS.items(), start=1):
        fixed += [(section, 0, ""), (section, 1, title), (section, 2, ",".join(CSV_TITLES[name]))]
    out = spark.createDataFrame(fixed, schema).unionByName(head)
    frames = section_frames(run)
    for section, name in enumerate(CSV_SECTIONS, start=1):
        if name in frames:
            lines = csv_lines(name, frames[name], run.keys)
            out = out.unionByName(lines.select(F.lit(section).alias("section"), F.lit(3).alias("part"), "line"))
    return out


def write_csv(run: Run, path: str, run_id: str) -> None:
    """Text files that read as one CSV document in the order of their names."""
    _write_lines(csv_document(run, run_id), path)


def json_findings(run: Run, run_id: str) -> DataFrame:
    """One record per finding of every check that ran, with the run's id."""
    listed = [each_finding(kind, frame, run.keys) for kind, frame in section_frames(run).items()]
    none = run.findings.limit(0).drop("findings")
    found = listed[0] if listed else none
    for frame in listed[1:]:
        found = found.unionByName(frame)
    return found.select(F.lit(run_id).alias("run_id"), "*")


def write_json(run: Run, path: str, run_id: str, timestamp: str) -> None:
    """The complete result: the summary with run id and time, and one JSON record per finding."""
    dated = run.summary.withColumn("run_id", F.lit(run_id)).withColumn("timestamp", F.lit(timestamp))
    dated.write.json(f"{path}/summary", ignoreNullFields=False)
    json_findings(run, run_id).write.json(f"{path}/findings", ignoreNullFields=False)


def markdown_cell(text: Column) -> Column:
    escaped = F.replace(text, F.lit("|"), F.lit("\\|"))
    return F.replace(escaped, F.lit("\n"), F.lit(" "))


def markdown_rows(name: str, df: DataFrame, keys: list[str] = ()) -> DataFrame:
    """The table lines of one section, without its header."""
    cells = [markdown_cell(t) for t in _texts(name, df, list(keys), ", ")]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def markdown_lines(run: Run, run_id: str) -> DataFrame:
    """The whole document as (section, part, line); sorted by these it reads in order."""
    spark = run.findings.sparkSession
    position = lambda df, section, part: df.select(
        F.lit(section).alias("section"), F.lit(part).alias("part"), "line"
    )
    head = run.summary.select(
        F.array(
            F.concat(F.lit(MARKDOWN_TITLE), "comparison"),
            F.lit(""),
            F.concat(F.lit(f"Run {run_id} — status: **"), "status", F.lit("**")),
            F.lit(""),
            F.concat(
                F.lit("Summary: "), F.col("passed").cast("string"), F.lit(" passed | "),
                F.col("warnings").cast("string"), F.lit(" warnings | "),
                F.col("failed").cast("string"), F.lit(" failed"),
            ),
            F.lit(""),
        ).alias("lines")
    )
    out = head.select(F.lit(0).alias("section"), F.posexplode("lines").alias("part", "line"))
    frames = section_frames(run)
    for section, (name, title) in enumerate(SECTIONS.items(), start=1):
        fixed = [(section, 0, f"## {title}"), (section, 1, ""), (section, 5, "")]
        out = out.unionByName(spark.createDataFrame(fixed, "section int, part int, line string"))
        titles = MARKDOWN_TITLES[name]
        header = ["| " + " | ".join(titles) + " |", "| " + " | ".join("---" for _ in titles) + " |"]
        if name in frames:
            body = markdown_rows(name, frames[name], list(run.keys))
            top = body.agg(F.count(F.lit(1)).alias("n")).select(
                F.posexplode(F.when(F.col("n") > 0, F.array(*map(F.lit, header))).otherwise(F.array(F.lit(MARKDOWN_NONE))))
                .alias("place", "line")
            )
            out = out.unionByName(top.select(F.lit(section).alias("section"), (F.col("place") + 2).alias("part"), "line"))
            out = out.unionByName(position(body, section, 4))
        else:
            out = out.unionByName(spark.createDataFrame([(section, 2, MARKDOWN_NONE)], out.schema))
    return out


def write_markdown(run: Run, path: str, run_id: str) -> None:
    """Text files that read as one document in the order of their names."""
    _write_lines(markdown_lines(run, run_id), path)


def _write_lines(lines: DataFrame, path: str) -> None:
    # The tie-break lets the sort spread equal lines, as a duplicated key gives, over many tasks.
    tied = lines.withColumn("tie", F.monotonically_increasing_id())
    tied.orderBy("section", "part", "line", "tie").select("line").write.text(path)
