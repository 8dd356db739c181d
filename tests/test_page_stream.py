"""A stream of paged answers resumes where it stopped; documents of the second hop come once."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from ledgerlight.sources import page_stream

SF = "/root/testdata/sf0.001"


def write(root, request, pages, last=None):
    """Pages (lists of records) as a service would give them; ``last``: the token that the last page names."""
    (root / request / "documents").mkdir(parents=True, exist_ok=True)
    have = len(list((root / request).glob("*.json")))
    for k, page in enumerate(pages, have):
        more = k < have + len(pages) - 1
        name = "first" if k == 0 else f"p{k}"
        (root / request / f"{name}.json").write_text(json.dumps(page | {"next_page_token": f"p{k + 1}" if more else last}))


def test_each_page_is_appended_once_over_runs(spark, tmp_path):
    orders = [r.asDict() for r in spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", F.col("o_orderpriority").alias("p")).orderBy("o_orderkey").collect()]
    root, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    of = {p: [{"bars": {p: [r["o_orderkey"] for r in orders if r["p"] == p][k : k + 40]}} for k in range(0, 160, 40)] for p in sorted({r["p"] for r in orders})}
    run = lambda: page_stream.append_new_pages(spark, str(root), out, state)
    got = lambda: sorted((r["request"], r["page_number"], r["records_received"], r["response_sha256"]) for r in spark.read.parquet(out).collect())
    for p, pages in of.items():
        write(root, p, pages[:2], last="p2")  # the third page is named and not there yet
    run()
    assert [x[:2] for x in got()] == [(p, k) for p in of for k in (1, 2)]
    run()  # nothing has come
    assert len(got()) == 2 * len(of)
    first = sorted(of)[0]
    write(root, first, of[first][2:])
    write(root, "new", [{"bars": {}}])
    run()
    wanted = [(p, k + 1) for p in [*of, "new"] for k in range(4 if p == first else 1 if p == "new" else 2)]
    assert [x[:2] for x in got()] == sorted(wanted)
    for request, number, n, digest in got():
        raw = (root / request / f"{'first' if number == 1 else f'p{number - 1}'}.json").read_bytes()
        assert digest == hashlib.sha256(raw).hexdigest() and n == sum(map(len, json.loads(raw)["bars"].values()))


def test_a_run_that_fails_in_the_middle_goes_on(spark, tmp_path):
    root, state = tmp_path / "in", str(tmp_path / "state")
    write(root, "a", [{"bars": {"A": [1]}}, {"bars": {"A": [2, 3]}}], last="p2")
    page_stream.register(spark)
    seen, fail = {}, [False]

    def keep(batch, number):
        rows = [r["page_number"] for r in batch.collect()]
        if fail[0]:
            raise RuntimeError("stopped here")
        seen[number] = sorted(rows)

    def run():
        rows = spark.readStream.format("paged_stream").option("path", str(root)).load()
        rows.writeStream.foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()

    run()
    write(root, "a", [{"bars": {}}])
    fail[0] = True
    with pytest.raises(Exception, match="stopped here"):
        run()
    fail[0] = False
    run()
    assert sorted(n for pages in seen.values() for n in pages) == [1, 2, 3]


def test_documents_of_the_second_hop(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet").orderBy("page_id").collect()
    root, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    lists = [[f"{p['page_id']}.htm" for p in pages[k : k + 30]] for k in (0, 30)]
    write(root, "cik1", [{"filings": names} for names in lists[:1]], last="p1")
    for p in pages:
        (root / "cik1" / "documents" / f"{p['page_id']}.htm").write_text(p["html"])
    run = lambda: page_stream.append_new_pages(spark, str(root), out, state, records="filings", follow="filings", documentsPerPartition="7")
    run()
    write(root, "cik1", [{"filings": lists[1]}])
    run()
    rows = spark.read.parquet(out)
    second = {(r["page_number"], r["document"]): r["response_payload"] for r in rows.filter("hop = 2").collect()}
    html = {f"{p['page_id']}.htm": p["html"] for p in pages}
    assert second == {(k + 1, name): html[name] for k, names in enumerate(lists) for name in names}
    assert rows.filter("hop = 2").count() == sum(map(len, lists)) and rows.filter("hop = 1").count() == 2


def test_pages_that_break_the_rules_fail(spark, tmp_path):
    for k, page in enumerate(({"next_page_token": " "}, {"next_page_token": 3}, {"next_page_token": "a/b"})):
        with pytest.raises(ValueError, match="names no new page"):
            (tmp_path / str(k)).mkdir()
            (tmp_path / str(k) / "first.json").write_text(json.dumps(page))
            page_stream.advance(str(tmp_path / str(k)), page_stream._BEGIN, 10)
    write(tmp_path, "long", [{"bars": {}}] * 5)
    with pytest.raises(ValueError, match="more than 3 pages"):
        page_stream.advance(str(tmp_path / "long"), page_stream._BEGIN, 3)
