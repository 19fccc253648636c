import re
from datetime import date

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyforge.functions import periods, pii
from tallyforge.operators import graph, guard, matchers, search, wiki
from tallyforge.plans import stored
from tallyforge.sources import files, ledger, pages, versions
from tallyforge.streaming import arrivals

ROWS = "id string, date date, amount int"


@pytest.fixture
def book(spark, tmp_path):
    return versions.Ledger(spark, f"file://{tmp_path}/ledger")


def rows(spark, *given):
    return spark.createDataFrame([(i, date.fromisoformat(d) if d else None, a) for i, d, a in given], ROWS)


def held(book, **at):
    return sorted((r.id, r.amount) for r in book.read("transactions", **at).collect())


def first(spark, book):
    book.commit({"transactions": versions.Change(rows(spark, ("a", "2025-01-05", 1), ("b", "2025-02-05", 2), ("c", None, 3)))})


def test_versions(spark, book):
    assert book.version() == 0 and book.read("transactions", ROWS).count() == 0
    with pytest.raises(KeyError):
        book.read("transactions")
    first(spark, book)
    new = rows(spark, ("a", "2025-01-05", 9), ("d", "2025-02-07", 4), ("d", "2025-02-07", 5))
    book.transact(lambda at: {"transactions": versions.insert(at, "transactions", new, ["id"], "amount")})
    assert held(book) == [("a", 1), ("b", 2), ("c", 3), ("d", 4)]
    assert held(book, version=1) == [("a", 1), ("b", 2), ("c", 3)]
    assert held(book, parts=["2025-02"]) == [("b", 2), ("d", 4)] and held(book, parts=["1999-01"]) == []
    book.transact(lambda at: {"transactions": versions.upsert(at, "transactions", rows(spark, ("b", "2025-02-05", 7)), ["id"], "amount")})
    assert held(book) == [("a", 1), ("b", 7), ("c", 3), ("d", 4)]


def test_only_touched_months_are_written_and_read(spark, book):
    first(spark, book)
    before = book.manifest()["tables"]["transactions"]["parts"]
    book.transact(lambda at: {"transactions": versions.upsert(at, "transactions", rows(spark, ("b", "2025-02-05", 7)), ["id"], "amount")})
    after = book.manifest()["tables"]["transactions"]["parts"]
    assert {p for p in before if before[p] != after[p]} == {"2025-02"}
    (read,) = book.read("transactions", parts=["2025-02"]).inputFiles()
    assert "part=2025-02" in read and len(book.read("transactions").inputFiles()) == 3


def test_joins_prune_partitions(spark, book):
    """A month's filter on the other side of a join reaches the scan while the query runs."""
    first(spark, book)
    wanted = spark.createDataFrame([("2025-01", "x"), ("2025-02", "y")], "part string, mark string").repartition(2)
    wanted.write.mode("overwrite").parquet(f"{book.path}/wanted")
    joined = book.read("transactions").join(F.broadcast(spark.read.parquet(f"{book.path}/wanted").where("mark = 'y'")), "part")
    assert "dynamicpruning" in joined._jdf.queryExecution().toString().lower()
    assert [r.id for r in joined.collect()] == ["b"]


def test_a_failed_write_is_invisible(spark, book, monkeypatch):
    first(spark, book)
    stage = versions.Ledger.stage

    def broken(self, name, df):
        stage(self, name, df)
        raise OSError("lost")

    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(versions.Ledger, "stage", broken)
        book.commit({"transactions": versions.Change(rows(spark, ("z", "2025-01-05", 1)))})
    assert held(book) == [("a", 1), ("b", 2), ("c", 3)] and book.version() == 1
    book.commit({"transactions": versions.Change(rows(spark, ("y", "2025-01-06", 1)))})
    assert book.vacuum(keep=1) == 1
    assert held(book) == [("a", 1), ("b", 2), ("c", 3), ("y", 1)] and book.versions() == [2]


def test_full_partitions_are_compacted(spark, book):
    first(spark, book)
    for k in range(3):
        book.commit({"transactions": versions.Change(rows(spark, (f"n{k}", "2025-02-09", k)))})
    before, parts = held(book), book.manifest()["tables"]["transactions"]["parts"]
    versions.compact(book, "transactions", folders=3)
    after = book.manifest()["tables"]["transactions"]["parts"]
    assert held(book) == before and len(after["2025-02"]) == 1 and after["2025-01"] == parts["2025-01"]
    assert held(book, version=1) == [("a", 1), ("b", 2), ("c", 3)]


def test_of_two_writers_one_waits(spark, book):
    first(spark, book)
    with pytest.raises(versions.Conflict):
        book.commit({"transactions": versions.Change(rows(spark, ("x", "2025-01-05", 1)))}, base=0)
    tried = []

    def change(at):
        if not tried:  # another writer is faster, once
            book.commit({"transactions": versions.Change(rows(spark, ("first", "2025-03-01", 1)))})
        tried.append(at.version)
        return {"transactions": versions.insert(at, "transactions", rows(spark, ("second", "2025-03-01", 2)), ["id"])}

    assert book.transact(change) == 3 and tried == [1, 2]
    assert {"first", "second"} <= {i for i, _ in held(book)}


def test_merchants_are_merged_in_one_commit(spark, book):
    t = spark.createDataFrame([("1", date(2025, 1, 1), "m1"), ("2", date(2025, 2, 1), "m2")], "id string, date date, merchant_id string")
    m = spark.createDataFrame([("m1", "One", ["x"]), ("m2", "Two", None)], "id string, canonical_name string, aliases array<string>")
    book.commit({"transactions": versions.Change(t), "merchants": versions.Change(m)})
    before = book.manifest()["tables"]["transactions"]["parts"]
    assert versions.merge_merchant(book, "m1", "m2") == 2
    assert {r.merchant_id for r in book.read("transactions").collect()} == {"m2"}
    assert [(r.id, r.aliases) for r in book.read("merchants").collect()] == [("m2", ["One", "x"])]
    assert book.manifest()["tables"]["transactions"]["parts"]["2025-02"] == before["2025-02"]


def test_migration(spark, book):
    c = spark.createDataFrame([(1, None), (2, 1), (3, 9)], "id int, parent_id int")
    m = spark.createDataFrame([(10, 1), (11, 3), (12, None)], "id int, category_id int")
    tables, refs, keys = {"merchants": m, "categories": c}, {"merchants": {"category_id": "categories"}, "categories": {"parent_id": "categories"}}, {"merchants": ["id"], "categories": ["id"]}
    want = [(0, "categories", 3, 1), (1, "merchants", 3, 1)]
    assert [tuple(r) for r in versions.migrate(book, tables, refs, keys, dry_run=True).orderBy("position").collect()] == want
    assert book.version() == 0
    for _ in range(2):
        assert [tuple(r) for r in versions.migrate(book, tables, refs, keys).orderBy("position").collect()] == want
        assert sorted(r.id for r in book.read("merchants").collect()) == [10, 12]
    with pytest.raises(ValueError, match="circle"):
        versions.dependency_order(["a", "b"], {"a": {"x": "b"}, "b": {"y": "a"}})
    with pytest.raises(KeyError):
        versions.migrate(book, {"merchants": m}, {"merchants": {"category_id": "nowhere"}}, keys)


def test_a_batch_that_dies_is_taken_once(spark, tmp_path, monkeypatch):
    """Killed after the transactions are written, and again after the commit: nothing is lost or doubled."""
    row = "2025-04-0{}  SHOP   4.50   100.00\n"
    batch = spark.createDataFrame([("s1", "acct_a", row.format(1) + row.format(2), "bank", "h1"), ("s2", "acct_a", row.format(2) + row.format(3), "bank", "h2"), ("s3", "acct_a", row.format(1) + row.format(2), "bank", "h1")], arrivals.ARRIVED)
    path = f"file://{tmp_path}/ledger"
    stage, publish = versions.Ledger.stage, versions.Files.publish

    def dies_between(self, name, df):
        if name == "statements":
            raise OSError("killed")
        return stage(self, name, df)

    def dies_after(self, at, text):
        publish(self, at, text)
        raise OSError("killed")

    for where, broken in ((versions.Ledger, ("stage", dies_between)), (versions.Files, ("publish", dies_after))):
        with monkeypatch.context() as m, pytest.raises(OSError):
            m.setattr(where, *broken)
            arrivals.ingest(batch, path, 0)
    arrivals.ingest(batch, path, 0)
    book = versions.Ledger(spark, path)
    assert sorted(r.date.day for r in book.read("transactions").collect()) == [1, 2, 3]
    assert sorted(r.id for r in book.read("statements").collect()) == ["s1", "s2"] and book.version() == 1
    arrivals.ingest(batch, path, 1)
    assert book.read("transactions").count() == 3


def test_pages_are_written_when_they_change(spark, tmp_path):
    at = f"file://{tmp_path}/wiki"
    made = spark.createDataFrame([("a/one.md", "1\n"), ("a/two.md", "2\n"), ("three ü.md", "3\n")], pages.SCHEMA)
    assert pages.write(made, at) == 3 and pages.write(made, at) == 0
    stamp = (tmp_path / "wiki/a/one.md").stat().st_mtime_ns
    assert pages.write(made.withColumn("content", F.when(F.col("name") == "a/two.md", "new\n").otherwise(F.col("content"))), at) == 1
    assert (tmp_path / "wiki/a/two.md").read_text() == "new\n" and (tmp_path / "wiki/a/one.md").stat().st_mtime_ns == stamp
    assert sorted(map(tuple, pages.read(spark, at).collect())) == [("a/one.md", "1\n"), ("a/two.md", "new\n"), ("three ü.md", "3\n")]
    with pytest.raises(Exception, match="not a page's name"):
        pages.write(spark.createDataFrame([("../out.md", "x")], pages.SCHEMA), at)
    assert not list((tmp_path / "wiki").rglob("*.tmp"))


def test_stored_index_reads_its_buckets_only(spark, tmp_path):
    e = spark.createDataFrame([("costco", "Costco", ["COSTCO UK"]), ("tesco", "Tesco", ["Tesco Express"]), ("amazon", "Amazon", ["AMZN Mktp"])], "id string, name string, aliases array<string>")
    search.build_index(e, f"{tmp_path}/index", buckets=8)
    for q in ("tesco express", "amzn", "uk tesco", "nothing", " "):
        assert search.search_index(spark, f"{tmp_path}/index", q).collect() == search.full_text(e, q).collect()
    plan = search.search_index(spark, f"{tmp_path}/index", "tesco")._jdf.queryExecution().toString()
    filters = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters: \[(.*?)\]", plan)
    assert "bucket" in filters[1] and "tesco" in filters[2]
    search.build_index(e.limit(0), f"{tmp_path}/none")
    assert search.search_index(spark, f"{tmp_path}/none", "tesco").count() == 0
    assert search.resolve(e, "tesco express", index=f"{tmp_path}/index").first().id == "tesco"


def test_deep_trees_and_circles(spark):
    chain = spark.createDataFrame([(0, None), *((i, i - 1) for i in range(1, 30))], "id int, parent_id int")
    assert sorted(map(tuple, graph.category_tree(chain).collect())) == sorted((i, j, i - j) for i in range(30) for j in range(i))
    assert graph.category_tree(chain.limit(0)).count() == 0
    for circle in ([(1, 1)], [(1, 2), (2, 3), (3, 1)], [(1, 2), (2, 3), (3, 4), (4, 5), (5, 2)]):
        with pytest.raises(ValueError, match="its own ancestor"):
            graph.category_tree(spark.createDataFrame(circle, "id int, parent_id int"))


def test_expensive_plans_are_refused(spark, tmp_path):
    spark.range(5000).selectExpr("id", "id % 7 k").write.parquet(f"{tmp_path}/t")
    t = spark.read.parquet(f"{tmp_path}/t")
    t.createOrReplaceTempView("plan_t")
    guard.refuse_expensive(spark.sql("SELECT a.id FROM plan_t a JOIN plan_t b ON a.id = b.id"))
    guard.refuse_expensive(spark.sql("SELECT a.id, m FROM plan_t a CROSS JOIN (SELECT MAX(k) m FROM plan_t)"), cartesian_bytes=1)
    with pytest.raises(guard.QueryRejected, match="all pairs"):
        guard.refuse_expensive(spark.sql("SELECT a.id FROM plan_t a CROSS JOIN plan_t b"), cartesian_bytes=1000)
    with pytest.raises(guard.QueryRejected, match="without a filter"):
        guard.refuse_expensive(spark.sql("SELECT id FROM plan_t"), scan_bytes=1000)
    guard.refuse_expensive(spark.sql("SELECT id FROM plan_t WHERE id < 9"), scan_bytes=1000)
    with pytest.raises(guard.QueryRejected, match="sorted, joined or grouped"):
        guard.refuse_expensive(spark.sql("SELECT k, COUNT(*) FROM plan_t GROUP BY k"), moved_bytes=1000)
    nodes = guard.explain(spark, "SELECT k, COUNT(*) FROM plan_t GROUP BY k")["nodes"]
    assert nodes[0].name == "Aggregate" and nodes[-1].name == "LogicalRelation" and all(n.bytes > 0 for n in nodes)


def test_jdbc_in_ranges(spark, tmp_path):
    """Derby comes with Spark."""
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    spark.range(100).selectExpr("id", "id % 3 k").write.format("jdbc").options(url=url, driver=driver, dbtable="t").save()
    whole = files.jdbc(spark, url, "t", driver=driver)
    assert whole.rdd.getNumPartitions() == 1
    cut = files.jdbc(spark, url, "t", '"id"', 4, driver=driver)
    assert cut.rdd.getNumPartitions() == 4 and sorted(r.id for r in cut.collect()) == list(range(100))
    assert "PushedFilters: [*IsNotNull(k), *EqualTo(k,1)]" in cut.where("k = 1")._jdf.queryExecution().toString()


class Session:
    """Tokens one message after the other, as a plain program would give them."""

    def __init__(self):
        self.token, self.count = {}, {}

    def name(self, kind, original):
        if original not in self.token:
            self.count[kind] = self.count.get(kind, 0) + 1
            self.token[original] = f"<<{kind}_{self.count[kind]:03d}>>"
        return self.token[original]

    def read(self, text):
        text = re.sub(pii.CARD, lambda m: self.name("CARD", m[0]) if pii._luhn(m[0]) else m[0], text or "")
        for pattern, kind in pii.PATTERNS:

            def put(m, kind=pii._KINDS.get(kind, kind), text=text):
                near = text[max(0, m.start() - pii.ACCOUNT_SPAN) : m.start()].lower()
                return self.name("ACCT" if kind == "NUM" and any(w in near for w in pii.ACCOUNT_WORDS) else kind, m[0])

            text = re.sub(pattern, put, text)
        return text


def test_tokens_equal_a_plain_program(spark, monkeypatch):
    monkeypatch.setattr(pii, "SEQ_BLOCK", 4)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("source", "doc_id", "text").collect()
    given = [(r.source, r.doc_id, r.text) for r in docs] + [("s", i, t) for i, t in enumerate(["a@b.cd 4111 1111 1111 1111 4111 1111 1111 1112", "account 12345678, 12345678  and 01234567890", "12-34-56 a@b.cd AB12 3CD 07123456789", None, "x@y.zz a@b.cd +44 20 7946 0958"])]
    want = {}
    for session in {g[0] for g in given}:
        state = Session()
        for _, seq, text in sorted(g for g in given if g[0] == session):
            want[session, seq] = state.read(text)
    got = pii.tokenize(spark.createDataFrame(given, "session string, seq long, text string").repartition(3)).collect()
    assert {(r.session, r.seq): r.text for r in got} == want
    assert sum("<<" in t for t in want.values()) > 10


def test_parsed_messages_leave_in_small_batches(spark):
    """A task holds the pieces of about PARSE_CHARS characters, not of a whole Arrow batch; batches are bounded in bytes."""
    texts = [f"mail a{k}@b.cd " + "x y " * (k % 500) if k % 10 else None for k in range(3000)] + ["z" * (2 * pii.PARSE_CHARS), ""]
    rows = [list(range(len(texts))), ["s"] * len(texts), list(range(len(texts))), texts]
    got = list(pii._parse(iter([pa.RecordBatch.from_arrays([pa.array(c) for c in rows], names=["id", "session", "seq", "text"])])))
    assert len(got) > 10
    for batch in got:
        chars = [len(texts[i] or "") for i in batch.column("id").to_pylist()]
        assert sum(chars[:-1]) < pii.PARSE_CHARS
    back = [(r["id"], "".join(r["found"][p["at"]]["value"] if p["literal"] is None else p["literal"] for p in r["pieces"])) for b in got for r in b.to_pylist()]
    assert back == [(k, t or "") for k, t in enumerate(texts)]
    pii.tokenize(spark.createDataFrame([("s", 1, "a@b.cd")], "session string, seq long, text string"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 4 << 20


def test_tolerant_dates(spark):
    given = {"2025-04-01": "2025-04-01", "20250401": "2025-04-01", "2025-04-01T23:59:59.5+02:00": "2025-04-01", "2025-04-01 10:00": "2025-04-01", "2025-04-31": None, "2025-4-1": None, "2025-04-01T25:00": None, "1 April": None, "": None, None: None}
    got = spark.createDataFrame([(k,) for k in given], "c string").select("c", periods.tolerant_date("c").cast("string").alias("d")).collect()
    assert {r.c: r.d for r in got} == given


def test_lengths_and_places(spark):
    d = spark.createDataFrame([('{"a": [1, {"b": "xyz"}], "o": {"p": 1, "q": 2}, "n": 123, "s": "123"}',)], "r string")
    r = F.col("r")
    ask = [matchers.list_length(r, "a", 2), matchers.list_length(r, "o", 2), matchers.list_length(r, "s", 3), matchers.list_length(r, "a.1.b", 3), matchers.list_length(r, "n", 3), matchers.list_length(r, "zz", 0), matchers.field_equals(r, "a.1.b", "xyz"), matchers.field_equals(r, "a[1].b", "xyz")]
    assert list(d.select(*ask).first()) == [True, True, True, True, False, False, True, True]


def test_pages_are_computed_once_a_write(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def said(name):
        seen.add(1)
        return f"{name}\n"

    made = spark.createDataFrame([("a/one.md",), ("b/two.md",)], "name string").withColumn("content", said.asNondeterministic()("name"))
    assert pages.write(made, f"file://{tmp_path}/wiki") == 2 and seen.value == 2
    assert pages.write(made, f"file://{tmp_path}/wiki") == 0 and seen.value == 4


def shuffled(spark):
    """Bytes that all stages so far have written to shuffles."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_rows_are_shuffled_once_a_commit_and_not_by_a_merge(spark, book):
    at = F.expr("date_add(date '2025-01-01', cast(id % 300 as int))")
    t = spark.range(20000).select(F.sha2(F.col("id").cast("string"), 256).alias("id"), at.alias("date"), F.format_string("m%d", F.col("id") % 50).alias("merchant_id"), F.sha2((-F.col("id")).cast("string"), 512).alias("note"))
    m = spark.createDataFrame([("m1", "One", ["x"]), ("m2", "Two", None)], "id string, canonical_name string, aliases array<string>")
    marks = [shuffled(spark)]

    def done():
        marks.append(shuffled(spark))
        return marks[-1] - marks[-2]

    book.commit({"transactions": versions.Change(t), "merchants": versions.Change(m)})
    once = done()
    assert once > 20000 * 100
    versions.merge_merchant(book, "m1", "m2")
    assert done() < once / 10
    later = t.withColumn("date", F.add_months("date", 24)).unionByName(t.limit(100))
    book.transact(lambda at: {"transactions": versions.insert(at, "transactions", later, ["id", "date"])})
    assert done() < once * 1.5
    assert book.read("transactions").count() == 40000
    book.transact(lambda at: {"transactions": versions.upsert(at, "transactions", t, ["id", "date"], "note")})
    assert done() < once * 2.5
    assert {r.merchant_id for r in book.read("transactions").where("date < '2026-01-01'").select("merchant_id").distinct().collect()} >= {"m1"}
    assert book.read("transactions").count() == 40000


@pytest.mark.parametrize("key", [["name", "date"], ["name"]])
def test_inserts_and_upserts_equal_a_plain_program(spark, book, monkeypatch, key):
    monkeypatch.setattr(versions, "SHARE", 4)
    fields = ["id", "name", "date", "amount"]
    some = lambda n, low: [(f"{low}-{i:03d}", None if i % 7 == 0 else f"n{i % 9}", None if i % 11 == 0 else date(2025, 1 + i % 3, 1 + i % 2), i % 5) for i in range(n)]
    rows = lambda given: spark.createDataFrame(given, "id string, name string, date date, amount int").repartition(3)
    of = lambda r: tuple(r[fields.index(k)] for k in key)
    month = lambda r: r[2] and r[2].month
    old, new = some(20, "a"), some(60, "b")
    book.commit({"transactions": versions.Change(rows(old))})
    book.transact(lambda at: {"transactions": versions.insert(at, "transactions", rows(new), key, "id")})
    touched = {month(r) for r in new}
    known, first = {of(r) for r in old if month(r) in touched and None not in of(r)}, {}
    for r in sorted(new):
        first.setdefault(of(r), r)
    want = sorted(old + [r for k, r in first.items() if k not in known])
    assert sorted(tuple(r) for r in book.read("transactions").select(*fields).collect()) == want

    newest = [(f"c{r[0]}", *r[1:3], 9) for r in new[:5]]
    book.transact(lambda at: {"transactions": versions.upsert(at, "transactions", rows(newest), key, "id")})
    touched, best = {month(r) for r in newest}, {}
    for r in sorted([r for r in want if month(r) in touched] + newest):
        best[of(r)] = r
    want = sorted([r for r in want if month(r) not in touched] + list(best.values()), key=str)
    assert sorted((tuple(r) for r in book.read("transactions").select(*fields).collect()), key=str) == want


def test_pages_join_transactions_once(spark):
    sf = "/root/testdata/sf0.001"
    assert "o_orderkey" not in stored._wiki(spark, sf)._jdf.queryExecution().optimizedPlan().toString()  # joined and kept before
    seen, plain = ledger.statements_seen(spark, sf), ledger.statements(spark, sf)
    links = ledger.transactions(spark, sf, "statement_id", "merchant_id")
    got, want = wiki.statement_pages(seen, links), wiki.statement_pages(plain, links)
    assert got.count() == want.count() > 1000 and not got.exceptAll(want).count() and not want.exceptAll(got).count()
    assert not seen.drop("merchants").exceptAll(plain).count()


def test_pages_are_stored_when_they_change(spark, tmp_path):
    """New, changed, changed back, repeated and empty pages; what is held is that of the last write, as of any version."""
    at = f"file://{tmp_path}/wiki"
    made = lambda *rows: spark.createDataFrame(rows, pages.SCHEMA)
    now = lambda **k: sorted(map(tuple, pages.stored(spark, at, **k).collect()))
    assert now() == []
    first = made(("a/1.md", "1"), ("a/2.md", "2"), ("b/ü.md", None), ("b/3.md", "z"), ("b/3.md", "y"))
    assert pages.store(first, at) == 4 and pages.store(first, at) == 0
    assert now() == [("a/1.md", "1"), ("a/2.md", "2"), ("b/3.md", "y"), ("b/ü.md", "")]
    assert pages.store(made(("a/1.md", "new"), ("a/2.md", "2"), ("c.md", "2")), at) == 2
    assert now() == [("a/1.md", "new"), ("a/2.md", "2"), ("b/3.md", "y"), ("b/ü.md", ""), ("c.md", "2")]
    assert pages.store(first, at) == 1 and pages.store(first, at) == 0
    assert now() == [("a/1.md", "1"), ("a/2.md", "2"), ("b/3.md", "y"), ("b/ü.md", ""), ("c.md", "2")]
    assert now(version=1) == [("a/1.md", "1"), ("a/2.md", "2"), ("b/3.md", "y"), ("b/ü.md", "")]


def test_all_kinds_of_pages_are_written_many_to_a_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stored, "scratch", lambda s, label: f"file://{tmp_path}/{label}")
    got = stored.registry.QUERIES["s15_written_pages"](spark, "/root/testdata/sf0.001")
    kinds = {r[0]: r[1] for r in got.groupBy(F.substring_index("name", "/", 1)).count().collect()}
    assert set(kinds) == set(wiki.KINDS) and kinds["statements"] == 4664
    assert 0 < len([p for p in tmp_path.rglob("*") if p.is_file()]) < 400
