import json
from datetime import date, datetime, timedelta
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import graph, guard, memo, mutations, replay, search
from tallyforge.plans import registry
from tallyforge.sources import files, sinks, versions
from tallyforge.sources import pages as page_files
from tallyforge.streaming import arrivals

WRITES = ["DELETE FROM t", "drop table t", "select 1; UPDATE t SET a=1", "create view v as select 1", "INSERT INTO t VALUES (1)", "MERGE INTO t USING s", "TRUNCATE t", "COPY t TO 'x'", "ALTER TABLE t", "GRANT ALL", "REVOKE ALL", "MATCH (n) DETACH DELETE n", "call apoc.refactor.x()"]


@pytest.mark.parametrize("sql", WRITES)
def test_writes_are_rejected(sql):
    with pytest.raises(guard.QueryRejected):
        guard.reject_writes(sql)


@pytest.mark.parametrize("sql", ["SELECT 1", "select 'DELETE me'", "WITH a AS (SELECT 1) SELECT * FROM a", "SELECT created_at, updates FROM t", "SELECT 'it''s; DROP' AS x;"])
def test_reads_are_allowed(sql):
    guard.reject_writes(sql)
    guard.reject_several(sql)


def test_execute(spark):
    spark.range(2001).createOrReplaceTempView("many")
    got = guard.execute(spark, "SELECT id FROM many", timeout_s=60)
    assert len(got.rows) == 1000 and got.truncated and got.columns == ["id"] and got.error is None
    assert guard.execute(spark, "SELECT id FROM many WHERE id < :n", {"n": 3}, timeout_s=60).rows == [{"id": 0}, {"id": 1}, {"id": 2}]
    assert "QueryRejected" in guard.execute(spark, "SELECT 1; SELECT 2").error
    assert guard.execute(spark, "SELECT nothing FROM many").error
    assert "expensive" in guard.execute(spark, "SELECT id FROM many", max_bytes=1).error
    assert guard.explain(spark, "SELECT id FROM many")["estimated_bytes"] > 0


def test_reconcile(spark):
    t = spark.createDataFrame([(date(2026, 3, d), D(a), "m1") for d, a in ((1, "120.00"), (15, "100.18"), (31, "122.00"))] + [(date(2026, 4, 1), D("9"), "m1")], "date date, amount decimal(18,2), merchant_id string")
    ask = lambda claim, a=date(2026, 3, 1), b=date(2026, 4, 1): guard.reconcile(t, a, b, claim, merchant_id="m1").first()
    assert ask("342.18").matches and not ask("500").matches and ask("342.185").matches
    none = ask("0", date(2020, 1, 1), date(2020, 2, 1))
    assert none.matches and none.n == 0


def test_actions():
    assert guard.invoke("publish_memo", "monthly_analyst", lambda x: x + 1, 1) == 2
    assert guard.invoke("upsert_account", "anyone", lambda: 3) == 3
    with pytest.raises(KeyError):
        guard.invoke("nothing", "x", lambda: 0)
    with pytest.raises(PermissionError):
        guard.invoke("publish_memo", "advisor", lambda: 0)


@pytest.fixture(scope="module")
def small_graph(spark):
    nodes = spark.createDataFrame([("m", "Merchant", {}), *[(f"t{i}", "Transaction", {"date": f"2025-04-0{i}", "amount": "1.00"}) for i in (1, 2, 3)], ("c1", "Category", {}), ("c2", "Category", {}), ("lone", "Merchant", {})], "id string, label string, props map<string,string>")
    edges = spark.createDataFrame([("t1", "m", "AT_MERCHANT"), ("t2", "m", "AT_MERCHANT"), ("t3", "m", "AT_MERCHANT"), ("t1", "c1", "IN_CATEGORY"), ("t2", "c2", "IN_CATEGORY"), ("t9", "m", "AT_MERCHANT")], "src string, dst string, type string")
    return nodes, edges


def test_graph(spark, small_graph):
    nodes, edges = small_graph
    kept = graph.anchored(edges, nodes)
    assert kept.count() == 5
    assert [r.id for r in graph.evidence(nodes, kept, "m", 2).collect()] == ["t3", "t2"]
    found, used = graph.neighbours(nodes, kept, "m", 2)
    assert {r.id for r in found.collect()} == {"m", "t1", "t2", "t3", "c1", "c2"} and used.count() == 5
    assert {r.id for r in graph.neighbours(nodes, kept, "m", 1)[0].collect()} == {"m", "t1", "t2", "t3"}
    assert graph.neighbours(nodes, kept, "lone", 3)[0].count() == 0
    with pytest.raises(ValueError):
        graph.neighbours(nodes, kept, "m", 5)
    assert {(r.from_label, r.n) for r in graph.stats(nodes, edges)[1].where("type = 'AT_MERCHANT'").collect()} == {("Transaction", 3), ("?", 1)}
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 2)], "id int, parent_id int")
    assert {tuple(r) for r in graph.category_tree(tree).collect()} == {(2, 1, 1), (3, 2, 1), (3, 1, 2)}


def test_resolve(spark):
    e = spark.createDataFrame([("costco", "Costco", ["COSTCO UK"]), ("tesco", "Tesco", ["Tesco Express"]), ("amazon", "Amazon", ["AMZN Mktp"])], "id string, name string, aliases array<string>")
    assert search.resolve(e, "tesco express").first().id == "tesco"
    assert search.resolve(e, "amzn").first().id == "amazon"
    assert search.resolve(e, "  ").count() == 0 and search.resolve(e, "zzz").count() == 0
    v = spark.createDataFrame([("costco", [1.0, 0.0]), ("tesco", [0.0, 1.0])], "id string, embedding array<float>")
    top = search.resolve(e, "tesco", [0.0, 1.0], v).first()
    assert (top.id, top.score) == ("tesco", round(2 / 60, 6))


def test_merges(spark):
    t = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, merchant_id string")
    m = spark.createDataFrame([("a", "A", ["x"]), ("b", "B", ["y"])], "id string, canonical_name string, aliases array<string>")
    moved, kept = mutations.merge_merchant(t, m, "a", "b")
    assert {r.merchant_id for r in moved.collect()} == {"b"}
    assert [(r.id, r.aliases) for r in kept.collect()] == [("b", ["A", "x", "y"])]
    with pytest.raises(KeyError):
        mutations.merge_merchant(t, m, "a", "zz")
    with pytest.raises(ValueError):
        mutations.merge_merchant(t, m, "a", "a")


def test_goal_upsert_keeps_the_id(spark):
    schema = "id string, name string, target_amount decimal(12,2), target_date date, scope_type string, scope_id string, status string"
    old = spark.createDataFrame([("g1", "Car", D("1"), date(2026, 1, 1), "custom", "x", "active")], schema)
    new = spark.createDataFrame([("g9", "Car", D("2"), date(2026, 1, 1), "custom", "x", "active"), ("g3", "Home", D("3"), date(2026, 1, 1), "custom", "x", "active")], schema)
    assert {(r.id, r.target_amount) for r in mutations.upsert_goals(old, new).collect()} == {("g1", D("2.00")), ("g3", D("3.00"))}
    with pytest.raises(Exception, match="bad goal"):
        mutations.upsert_goals(old, new.withColumn("scope_type", F.lit("odd"))).collect()


def test_pattern_change_frees_transactions(spark):
    p = "id string, merchant_id string, expected_amount decimal(12,2)"
    old = spark.createDataFrame([("p1", "m", D("1")), ("p2", "m", D("2"))], p)
    new = spark.createDataFrame([("p1", "m", D("9")), ("p2", "m", D("2")), ("p3", "n", D("3"))], p)
    t = spark.createDataFrame([("1", "p1"), ("2", "p2"), ("3", None)], "id string, pattern_id string")
    patterns, freed = mutations.upsert_patterns(old, new, t)
    assert {r.id: r.expected_amount for r in patterns.collect()} == {"p1": D("9.00"), "p2": D("2.00"), "p3": D("3.00")}
    assert {r.id: r.pattern_id for r in freed.collect()} == {"1": None, "2": "p2", "3": None}


def test_redirects_and_keys(spark):
    r = "old_id string, new_id string"
    a = spark.createDataFrame([("x_1", "x"), ("y_1", "y")], r)
    b = spark.createDataFrame([("x", "z"), ("y", "y_1"), ("q", "z")], r)
    assert {tuple(x) for x in mutations.compose_redirects(a, b).collect()} == {("x_1", "z"), ("x", "z"), ("y", "y_1"), ("q", "z")}
    asked = spark.createDataFrame([("k1", 1), ("k1", 2), ("k0", 3), ("k2", 4)], "idempotency_key string, arrived long")
    seen = spark.createDataFrame([("k0",)], "idempotency_key string")
    assert {x.arrived for x in mutations.accept_once(asked, seen).where("duplicate").collect()} == {2, 3}


def test_every_decision_is_replayed(spark, tmp_path):
    """All purchases of a log with equal times, against brute force."""
    kinds = ["purchase", "view", "click", "purchase", "purchase"]
    rows = [(i, datetime(2024, 1, 1) + timedelta(minutes=i * 37 % 101), kinds[i % 5]) for i in range(2200)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    got = {tuple(r) for r in registry.QUERIES["q7_replay_decisions"](spark, str(tmp_path)).select("decision_id", "live_pages", "prior_decisions", "drift").collect()}
    asks = [r for r in rows if r[2] == "purchase"]
    assert got == {(str(i), sum(r[1] <= at for r in rows), sum(r[1] < at for r in asks), i % 1000 == 0 and i > 0) for i, at, _ in asks}
    assert len(got) == len(asks)


def test_replay(spark):
    log = spark.createDataFrame([(1, "Page", "f2"), (2, "Decision", "f2"), (2, "Page", "f2"), (3, "Decision", "f2")], "ts long, type string, fingerprint string")
    asks = spark.createDataFrame([("d1", 2, "f1"), ("d2", 3, "f2"), ("d3", 0, "")], "decision_id string, cutoff long, recorded string")
    assert {tuple(r) for r in replay.replay(log, asks).collect()} == {("d1", 3, 0, True), ("d2", 4, 1, False), ("d3", 0, 0, False)}


def test_fingerprints(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "p string, n int")
    digest = lambda df: replay.fingerprint(df, "p", "n").first().digest
    assert digest(a) == digest(a.orderBy(F.desc("p"))) != digest(a.limit(1))
    assert replay.counts_digest(replay.table_counts({"a": a, "b": a})).first().digest == replay.counts_digest(replay.table_counts({"b": a, "a": a})).first().digest


def test_pages(spark, tmp_path):
    (tmp_path / "memos").mkdir()
    (tmp_path / "memos" / "m1.md").write_text("---\nid: memo_2025_04\ntype: Memo\nstatus: 'draft'\nlist:\n  - x\n---\n# Body\ntext")
    (tmp_path / "memos" / "m1 2.md").write_text("---\nid: copy\n---\n")
    (tmp_path / "plain.md").write_text("x" * 5000)
    pages = files.pages(files.read_texts(spark, str(tmp_path))).cache()
    assert {r.id for r in pages.collect()} == {"memo_2025_04", "plain"}
    assert [r.body for r in files.list_pages(pages, "Memo", "draft").collect()] == ["# Body\ntext"]
    assert files.list_pages(pages, "Memo", "final").count() == 0
    assert len(pages.where("id = 'plain'").first().body) == 4000
    assert files.project_pages(pages, "Memo", "id string, status string, amount double").first()[:] == ("memo_2025_04", "draft", None)
    raw = files.read_binaries(spark, str(tmp_path), "*.md")
    assert raw.where("length = 5000").first().sha256 == __import__("hashlib").sha256(b"x" * 5000).hexdigest()


def test_records(spark, tmp_path):
    given = {"target_type": "Budget", "mapping": {"id": "id", "period": "period", "kind": "scope_type", "target": "target_amount"}, "validation": {"required": ["id", "period"], "scope_type_in": ["category", "merchant"]}, "numbers": ["target_amount"]}
    m = files.Manifest.load(given)
    (tmp_path / "ok.csv").write_text("id,period,kind,target\n b1 ,2025_04,category,100\nb2,2025_05,,\n")
    rows = files.checked_records(files.read_records(spark, str(tmp_path / "ok.csv"), m), m).collect()
    assert [(r.id, r.scope_type, r.target_amount) for r in rows] == [("b1", "category", 100.0), ("b2", None, None)]
    for bad, why in (("b1,,category,1", "period is required"), ("b1,x,odd,1", "scope_type is not one of"), ("b1,x,category,abc", "not a number")):
        (tmp_path / "bad.csv").write_text(f"id,period,kind,target\nb0,p,category,1\n{bad}\n")
        with pytest.raises(ValueError, match=why):
            files.checked_records(files.read_records(spark, str(tmp_path / "bad.csv"), m), m)
    with pytest.raises(ValueError):
        files.Manifest.load({"target_type": "Odd", "mapping": {"a": "b"}})


def test_sinks(spark, tmp_path):
    acts = spark.createDataFrame([("2025-04-01T10:20:30.123456+00:00", "upsert_goal", "user", "{}", "ok")], "ts string, action string, actor string, inputs string, result string")
    for _ in range(2):
        sinks.append_audit(acts, str(tmp_path / "audit"))
    rows = spark.read.json(str(tmp_path / "audit"))
    assert rows.count() == 2 and rows.first().decision_id == "dec_20250401T102030123_upsert_goal_user"
    pages = memo.entity_pages(spark.createDataFrame([("a", "Acme")], "id string, title string"), spark.createDataFrame([("a", "s2"), ("a", "s1"), ("a", "s1")], "id string, member string"), "Merchant")
    assert page_files.write(pages, f"file://{tmp_path}/pages") == 1
    assert (tmp_path / "pages" / "a.md").read_text() == "---\nid: a\ntype: Merchant\n---\n# Acme\n\n- [[s1]]\n- [[s2]]\n"
    (tmp_path / "g.jsonl").write_text("\n".join(map(json.dumps, [{"kind": "node", "id": "a", "type": "M"}, {"kind": "edge", "source": "a", "target": "b", "type": "T"}])))
    nodes, edges = files.graph_snapshot(spark, str(tmp_path / "g.jsonl"))
    assert nodes.count() == 1 and edges.first().target == "b"


def test_missing_memos(spark):
    held = spark.createDataFrame([("2025_02",)], "period string")
    assert sorted(r.period for r in memo.missing_periods(held, "2025_01", "2025_03").collect()) == ["2025_01", "2025_03"]


def test_arrivals(spark, tmp_path):
    inbox, ledger, state = tmp_path / "in" / "credit", tmp_path / "ledger", tmp_path / "state"
    inbox.mkdir(parents=True)
    row = "2025-04-0{}  SHOP   4.50   100.00\n"
    (inbox / "one.md").write_text(row.format(1) + row.format(2))

    def run():
        q = arrivals.start_ingest(spark, str(tmp_path / "in"), str(ledger), str(state))
        q.awaitTermination(120)
        assert q.exception() is None
        return versions.Ledger(spark, str(ledger)).read("transactions")

    first = run()
    assert {(r.date.day, r.amount) for r in first.collect()} == {(1, D("-4.50")), (2, D("-4.50"))}
    (inbox / "copy.md").write_text(row.format(1) + row.format(2))
    (inbox / "two.md").write_text(row.format(3) * 2)
    assert run().count() == 3
    assert run().count() == 3


def test_overlapping_statements_are_stored_once(spark, tmp_path):
    """Two months' files of one account share a transaction; the same month of another account is its own."""
    row = "2025-04-0{}  SHOP   4.50   100.00\n"
    for folder, name, days in (("savings", "2025_04.md", (1, 2)), ("savings", "2025_05.md", (2, 3)), ("joint", "2025_04.md", (1,))):
        (tmp_path / "in" / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / folder / name).write_text("".join(map(row.format, days)))
    q = arrivals.start_ingest(spark, str(tmp_path / "in"), str(tmp_path / "ledger"), str(tmp_path / "state"))
    q.awaitTermination(120)
    assert q.exception() is None
    got = versions.Ledger(spark, str(tmp_path / "ledger")).read("transactions").collect()
    assert sorted((r.account_id, r.date.day) for r in got) == [("acct_joint", 1), ("acct_savings", 1), ("acct_savings", 2), ("acct_savings", 3)]
    assert {r.statement_id for r in got} <= {"stmt_joint_2025_04", "stmt_savings_2025_04", "stmt_savings_2025_05"}


def test_matchers(spark):
    from tallyforge.operators import matchers as m

    rows = [('{"a": {"b": [{"c": 4.02}]}, "kinds": ["x1", "y"], "body": "## Top\\ntext"}', ["p", "q"]), ('{"a": 3}', None), (None, [])]
    d = spark.createDataFrame(rows, "r string, citations array<string>")
    r = F.col("r")
    made = [m.numeric_field(r, "a.b[0].c", "approx", 4.0), m.numeric_field(r, "a", "lt", 5), m.regex_match(r, "kinds", "^y$|x1"), m.list_length(r, "kinds", 2), m.contains_substring(r, "body", "text"), m.section_present(m.resolve(r, "body"), "Top"), m.citation_count_gte(F.col("citations"), 2), m.field_equals(r, "a", "3")]
    got = [tuple(x) for x in d.select(*made).collect()]
    assert got == [(True, False, True, True, True, True, True, False), (False, True, False, False, False, False, False, True), (False,) * 8]
    assert m.returns_row(d.selectExpr("1 a", "'k' b"), [1, "k"]) and not m.returns_row(d.where("false"), [1])


def test_names_that_end_alike(spark):
    names = [(f"{w} Services Limited", []) for w in ("Alpha", "Beta", "Gamma")]
    merchants = spark.createDataFrame(names, "canonical_name string, aliases array<string>")
    said = spark.createDataFrame([("to BETA services limited 9",), ("Delta Services Limited",), ("alpha services limite",)], "raw_description string")
    assert sorted(r[0] for r in mutations.new_descriptions(said, merchants).collect()) == ["Delta Services Limited", "alpha services limite"]


def test_event_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    q = arrivals.event_windows(stream, late="60 days").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(spark.table("windows").collect()) == sorted(arrivals.event_windows(events).collect())


def test_graph_is_written_when_a_value_changes(spark, tmp_path):
    v, e = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int"), spark.createDataFrame([("a", "b")], "src string, dst string")
    path = str(tmp_path / "graph")
    assert sinks.write_graph(v, e, path)
    assert not sinks.write_graph(v.orderBy(F.desc("id")), e, path)
    assert sinks.write_graph(v, e, path, force=True)
    assert sinks.write_graph(v.withColumn("n", F.lit(7)), e, path)
    assert {r.n for r in spark.read.parquet(f"{path}/vertices").collect()} == {7}
    assert sinks.write_graph(v.limit(0), e.limit(0), path)


def test_rules_are_kept(spark, tmp_path):
    path = str(tmp_path / "rules")
    assert sinks.kept_rules(spark, path).count() == 0
    schema = "surface string, merchant_id string, category_id int"
    sinks.keep_rules(spark.createDataFrame([("x", "m_1", 1), ("y", "m_2", None)], schema), path)
    sinks.keep_rules(spark.createDataFrame([("x", "m_3", 2)], schema), path)
    assert sorted(map(tuple, sinks.kept_rules(spark, path).collect())) == [("x", "m_3", 2), ("y", "m_2", None)]


def test_report(spark, tmp_path):
    summary = spark.createDataFrame([("b", 3, 1), ("a", 2, 2)], "suite string, total long, passed long")
    sinks.write_report(summary, f"file://{tmp_path}/report")
    assert spark.read.json(str(tmp_path / "report/json")).count() == 2
    text = sinks.report_page(summary).first().content
    assert "3 of 5 passed" in text and text.index("| a | 2/2 |") < text.index("| b | 1/3 |")
    assert "0 of 0 passed" in sinks.report_page(summary.limit(0)).first().content


def test_backfill(spark):
    memos = spark.createDataFrame([("2024_02", "kept")], "period string, body_md string")
    one = lambda p: spark.createDataFrame([(p, f"memo of {p}")], "period string, body_md string")
    assert [r.period for r in memo.backfill(memos, "2024_01", "2024_03", one).collect()] == ["2024_01", "2024_03"]
    assert memo.backfill(memos, "2024_02", "2024_02", one) is None


def test_edges_of_a_ledger_equal_those_of_its_vertices(spark):
    """Unknown merchants, categories and accounts, nulls, rows twice and one id in two statements; the edges of a transaction are not moved."""
    t = spark.createDataFrame([("t1", "a1", "s1", "m1", 1), ("t1", "a1", "s1", "m1", 1), ("t1", "a1", "s2", "m1", 1), ("t2", "a9", "s3", "m9", 9), ("t3", "a1", "s1", None, None), ("t4", None, None, "m1", 2)], "id string, account_id string, statement_id string, merchant_id string, category_id int")
    full = t.withColumn("date", F.lit(None).cast("date")).withColumn("amount", F.lit(1))
    accounts = spark.createDataFrame([("a1", "A", "savings")], "id string, name string, type string")
    categories = spark.createDataFrame([(1, "food"), (2, "fuel")], "id int, name string")
    merchants = spark.createDataFrame([("m1", "One")], "id string, canonical_name string")
    st = t.where("statement_id is not null").select("account_id", F.col("statement_id").alias("id")).distinct().withColumn("period_start", F.lit(None).cast("date")).withColumn("period_end", F.lit(None).cast("date"))
    nodes = graph.vertices(accounts, st, categories, merchants, full.dropDuplicates(["id"]))
    got = graph.ledger_edges(accounts, categories, merchants, t)
    want = graph.anchored(graph.edges(st, t), nodes)
    assert sorted(tuple(r) for r in got.select("src", "dst", "type").collect()) == sorted(tuple(r) for r in want.collect())
    assert sorted(tuple(r) for r in graph.stats(nodes, got)[1].collect()) == sorted(tuple(r) for r in graph.stats(nodes, want)[1].collect())
    allowed = spark.createDataFrame([("Transaction", "AT_MERCHANT", "Merchant")], "from_label string, type string, to_label string")
    assert graph.undeclared_links(nodes, got, allowed).count() == graph.undeclared_links(nodes, want, allowed).count()
    moved = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "RepartitionByExpression" in line]
    assert len(moved) == 1 and "src" not in moved[0]
