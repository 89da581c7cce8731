import csv
import json
from pathlib import Path

import pytest

from concord.functions.normalize import Rule, Tolerance
from concord.plans.run import FINDING_FIELDS, Checks, Definition, run_comparison
from concord.sinks import exports, history
from concord.sources.sides import Derived, ParquetFiles, Query, SqlFile, Table, capped, label, load
from seeded import CUSTOMER_MAPPING, CUSTOMER_SOURCE, CUSTOMER_TARGET, pair

ALL = Checks(schema=True, profile=True, row_count=True, row_level=True)


def customer(**options):
    fields = {"keys": ["CustomerID"], "mapping": CUSTOMER_MAPPING, "checks": ALL, **options}
    return Definition("Customer check", Query(CUSTOMER_SOURCE + " ; "), Query(CUSTOMER_TARGET), **fields)


def test_full_run(spark):
    run = run_comparison(spark, customer())
    assert run.findings.columns == list(FINDING_FIELDS)
    kinds = {r.kind: r["sum(findings)"] for r in run.findings.groupBy("kind").sum("findings").collect()}
    assert (kinds["schema"], kinds["volume"], kinds["rows"]) == (9, 1, 8)
    summary = run.summary.first()
    assert (summary.status, summary.source_rows, summary.target_rows, summary.difference) == ("failed", 6, 7, 1)
    assert summary.passed + summary.warnings + summary.failed == sum(kinds.values())
    assert (summary.source_label, summary.target_label) == ("(custom query)", "(custom query)")
    matching = run.findings.where("category = 'matching'").collect()
    assert [(r.findings, r.severity) for r in matching] == [(3, "Pass")]
    changed = run.findings.where("category = 'matched-key-differing-values'").first()
    assert changed.key_values == ["2"] and changed.column_differences[0].source_value == "Jane Roe"


def test_subsets_and_status(spark):
    only_schema = run_comparison(spark, customer(), ["schema"])
    assert only_schema.rows is None and only_schema.volume is None
    assert {r.kind for r in only_schema.findings.collect()} == {"schema"}
    assert only_schema.summary.first().source_rows == 0
    source, _ = pair(spark, "customer")
    same = Definition("same", source, source, ["CustomerID"], [(c, c) for c in source.columns], checks=ALL)
    summary = run_comparison(spark, same).summary.first()
    assert (summary.status, summary.warnings, summary.failed) == ("passed", 0, 0)
    twice = Definition("twice", source, source.union(source), ["CustomerID"], checks=Checks(row_level=True))
    assert run_comparison(spark, twice).summary.first().status == "warning"
    nothing = run_comparison(spark, customer(checks=Checks()))
    assert nothing.summary.first().status == "passed" and nothing.findings.isEmpty()
    with pytest.raises(ValueError, match="unknown checks"):
        run_comparison(spark, customer(), ["rows"])


def test_unreadable_side_is_a_failed_run(spark):
    broken = Definition("broken", Table("no_such_table"), Query(CUSTOMER_TARGET), ["a"], checks=ALL)
    run = run_comparison(spark, broken)
    summary = run.summary.first()
    assert (summary.status, summary.failed, summary.source_label) == ("failed", 1, "no_such_table")
    assert run.findings.isEmpty()


def test_exclusion_reaches_every_check(spark):
    run = run_comparison(spark, customer(exclude_columns=["CUSTOMER_NAME", "CreditLimit"]))
    named = {r.column_name for r in run.findings.collect()}
    assert not named & {"CustomerName", "CUSTOMER_NAME", "CreditLimit"}
    assert run.findings.where("category = 'matched-key-differing-values'").isEmpty()


def test_where_reaches_every_check(spark, tmp_path):
    source, target = pair(spark, "customer")
    source.write.parquet(str(tmp_path / "s"))
    target.write.parquet(str(tmp_path / "t"))
    definition = Definition(
        "where", ParquetFiles(str(tmp_path / "s"), "CustomerID < 4"), ParquetFiles(str(tmp_path / "t"), "CUSTOMER_ID < 4"),
        ["CustomerID"], CUSTOMER_MAPPING, checks=ALL,
    )
    summary = run_comparison(spark, definition).summary.first()
    assert (summary.source_rows, summary.target_rows, summary.source_label) == (3, 3, "s")


def test_hash_strategy_and_limits(spark):
    full = run_comparison(spark, customer(checks=Checks(row_level=True)))
    hashed = run_comparison(spark, customer(checks=Checks(row_level=True, strategy="hash")))
    counts = lambda run: sorted(tuple(r) for r in run.findings.groupBy("severity").sum("findings").collect())
    assert counts(full) == counts(hashed)
    few = run_comparison(spark, customer(checks=Checks(row_level=True, max_differences=2)))
    assert few.findings.where("key_values IS NOT NULL").count() == 2 and counts(few) == counts(full)
    assert few.summary.first() == full.summary.first()
    with pytest.raises(ValueError, match="strategy"):
        run_comparison(spark, customer(checks=Checks(row_level=True, strategy="other")))
    tops = run_comparison(spark, customer(checks=Checks(profile=True, top_values=1))).top_values
    assert {r.column_name for r in tops.collect()} >= {"CustomerName", "IsActive"}


def test_derived_mapping_in_a_run(spark):
    mapping = [*CUSTOMER_MAPPING[:1], Derived("initial", "initial", "left(CustomerName, 4)", "left(CUSTOMER_NAME, 4)")]
    run = run_comparison(spark, customer(mapping=mapping, checks=Checks(row_level=True)))
    assert run.findings.where("category = 'matched-key-differing-values'").isEmpty()


def test_sides(spark, tmp_path):
    (tmp_path / "q.sql").write_text("SELECT 1 AS a;\n")
    assert load(spark, SqlFile("q.sql", str(tmp_path))).first().a == 1
    with pytest.raises(ValueError, match="outside"):
        load(spark, SqlFile("../q.sql", str(tmp_path / "x")))
    spark.range(5).createOrReplaceTempView("five")
    assert load(spark, Table("five", "id > 2")).count() == 2
    assert capped(spark.range(5), None).count() == 5 and capped(spark.range(5), 2).count() == 2
    assert [label(s) for s in (Table("a.b"), SqlFile("x/y.sql"), Query("SELECT 1"))] == ["a.b", "y.sql", "(custom query)"]


def test_exports(spark, tmp_path):
    run = run_comparison(spark, customer())
    exports.write_json(run, str(tmp_path / "json"), "run-1", "2026-01-01T00:00:00.000Z")
    back = spark.read.json(str(tmp_path / "json" / "findings"))
    rows = back.where("kind = 'rows'").collect()
    assert len(rows) == 8 and sum(r.category == "duplicate-in-target" for r in rows) == 2
    assert {r.run_id for r in back.collect()} == {"run-1"}
    one = json.loads(next(l for f in (tmp_path / "json" / "summary").glob("*.json") for l in f.read_text().splitlines()))
    assert one["comparison"] == "Customer check" and one["failed"] > 0
    assert (one["run_id"], one["timestamp"]) == ("run-1", "2026-01-01T00:00:00.000Z")
    exports.write_csv(run, str(tmp_path / "csv"), "run-1")
    text = "".join(p.read_text() for p in sorted(Path(tmp_path / "csv").glob("part-*")))
    assert text.startswith("Section,Comparison,RunId,Status\nSummary,Customer check,run-1,failed\n\nSchema Differences\nSeverity,")
    assert "\n\nVolume (Aggregate) Differences\nSeverity,SourceCount," in text
    rows = list(csv.DictReader(text[text.index("Severity,Category") :].splitlines()))
    assert len(rows) == 8 and sum(r["Category"] == "duplicate-in-target" for r in rows) == 2
    assert {r["ColumnDifferences"] for r in rows if r["Category"] == "matched-key-differing-values"} == {
        "CUSTOMER_NAME: Jane Roe -> Jane R. Doe"
    }
    exports.write_markdown(run, str(tmp_path / "md"), "run-1")
    text = "".join(p.read_text() for p in sorted(Path(tmp_path / "md").glob("part-*")))
    assert text.startswith("# Parity Results: Customer check\n\nRun run-1 — status: **failed**\n\nSummary: ")
    assert text.index("## Schema Differences") < text.index("## Profile Differences") < text.index("## Volume Parity")
    assert "| Severity | Category | Key Values | Message | Column Differences |\n| --- | --- | --- | --- | --- |\n| " in text
    empty = run_comparison(spark, customer(), ["row_count"])
    exports.write_markdown(empty, str(tmp_path / "md2"), "run-2")
    text = "".join(p.read_text() for p in sorted(Path(tmp_path / "md2").glob("part-*")))
    assert "## Schema Differences\n\n_None._\n\n## Profile" in text


def test_quoting(spark):
    df = spark.createDataFrame([("a,b",), ('say "x"',), ("two\nlines",), ("plain",)], "s string")
    assert [r[0] for r in df.select(exports.csv_field(df.s)).collect()] == ['"a,b"', '"say ""x"""', '"two\nlines"', "plain"]
    cells = spark.createDataFrame([("a|b\nc",)], "s string")
    assert cells.select(exports.markdown_cell(cells.s)).first()[0] == "a\\|b c"


def test_history(spark, tmp_path):
    root = str(tmp_path / "history")
    assert history.list_runs(spark, root).isEmpty()
    run = run_comparison(spark, customer(checks=Checks(row_count=True, row_count_tolerance=Tolerance(absolute=5))))
    failed = run_comparison(spark, customer())
    first = history.persist_run(run, root, "2026-01-01T00:00:00.000Z")
    second = history.persist_run(failed, root, "2026-01-02T00:00:00.000Z")
    with pytest.raises(ValueError, match="already recorded"):
        history.persist_run(run, root, "2026-01-01T00:00:00.000Z")
    listed = history.list_runs(spark, root).collect()
    assert [(r.run_id, r.status) for r in listed] == [(second, "failed"), (first, "passed")]
    assert history.load_run(spark, root, first).count() == 1
    assert history.load_run(spark, root, second).count() == failed.findings.count()
    assert history.latest_runs(spark, root, "Customer check").first().run_id == second
    damaged = Path(root, "runs", "run_id=damaged")
    damaged.mkdir()
    (damaged / "part-0.parquet").write_bytes(b"not parquet")
    assert history.list_runs(spark, root).count() == 2


def _spaces(spark, **options):
    source = spark.createDataFrame([(" k1 ", "a"), ("k2", "x")], "k string, v string")
    target = spark.createDataFrame([(" k1 ", " b "), ("k2", "x")], "k string, v string")
    return run_comparison(spark, Definition("spaces", source, target, ["k"], [("v", "v")], checks=Checks(row_level=True, **options)))


def test_csv_keeps_edge_spaces(spark, tmp_path):
    exports.write_csv(_spaces(spark), str(tmp_path / "csv"), "run-1")
    text = "".join(p.read_text() for p in sorted(Path(tmp_path / "csv").glob("part-*")))
    assert ", k1 ," in text and text.count("v: a ->  b ") == 1 and "v: a ->  b \n" in text


def test_hash_strategy_compares_tolerant_columns_by_value(spark):
    source = spark.createDataFrame([(1, 125.364, "a"), (2, 1.0, "b"), (3, 5.0, "c")], "k int, p double, t string")
    target = spark.createDataFrame([(1, 125.370, "a"), (2, 1.5, "b"), (3, 5.001, "C")], "k int, p double, t string")
    found = []
    for strategy in ("full", "hash"):
        rules = {"p": Rule(numeric_tolerance=Tolerance(absolute=0.01))}
        definition = Definition("d", source, target, ["k"], [("p", "p"), ("t", "t")], rules=rules, checks=Checks(row_level=True, strategy=strategy))
        found.append(sorted((r.k, r.category) for r in run_comparison(spark, definition).rows.collect()))
    assert found[0] == found[1] and [c for _, c in found[0]] == ["matching", *["matched-key-differing-values"] * 2]
    missing = Definition("d", source, target, ["k"], [("p", "gone")], checks=Checks(row_level=True, strategy="hash"))
    assert {r.category for r in run_comparison(spark, missing).rows.collect()} == {"unable-to-compare"}


def test_a_broken_attempt_can_be_repeated(spark, tmp_path):
    root, stamp = str(tmp_path / "history"), "2026-01-01T00:00:00.000Z"
    run = _spaces(spark)
    broken = f"{root}/findings/run_id={history.run_id_for(run.name, stamp)}"
    run.findings.write.parquet(broken)  # the first attempt ended before its summary
    assert history.list_runs(spark, root).isEmpty()
    run_id = history.persist_run(run, root, stamp)
    (listed,) = history.list_runs(spark, root).collect()
    assert (listed.run_id, listed.failed) == (run_id, 1)


def test_runs_of_one_moment_stay_apart(spark, tmp_path):
    run = _spaces(spark)
    ids = {history.persist_run(run, str(tmp_path / "history")) for _ in range(2)}
    assert len(ids) == 2 and history.list_runs(spark, str(tmp_path / "history")).count() == 2
    stamp = "2026-01-01T00:00:00.000Z"
    assert history.run_id_for("orders v1.0", stamp) != history.run_id_for("orders v1_0", stamp)
