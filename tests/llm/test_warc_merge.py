"""Captures merged over several runs and ranges, ids of 64 bits, and clashing columns."""

from collections import Counter

from spectrafold.llm import warc
from spectrafold.llm.shared import new_folder


def test_many_runs_and_ranges(spark, monkeypatch):
    for name, value in (("RANGE", 40), ("RUN", 7), ("BLOCK", 3), ("FAN", 4), ("ROLL", 2000)):
        monkeypatch.setattr(warc, name, value)
    ids = [*range(120), 10**12, -(10**11), 2**62, -(2**62)]
    pages = [(i, f"http://h{abs(i) % 5}.org/{abs(i) % 11}", f"payload {abs(i) % 60}", "clash", i) for i in ids]
    table = spark.createDataFrame(pages, "page_id long, url string, html string, archive string, offset long").repartition(5)
    found = warc.archive(table, new_folder(spark, "warc"))
    rows = found.collect()
    assert Counter(r["page_id"] for r in rows) == Counter(ids)
    order = [warc.order(tuple(r)) for r in rows]
    assert order == sorted(order) and found.rdd.getNumPartitions() > 1
    last = {}
    for i, _, html, *_ in pages:
        last[html] = max(i, last.get(html, i))
    assert all((r["record_type"], r["refers_to"]) == (("response", None) if last[f"payload {abs(r['page_id']) % 60}"] == r["page_id"] else ("revisit", last[f"payload {abs(r['page_id']) % 60}"])) for r in rows)
