"""Cases that the tables do not hold: short and quoted passages, late events, long groups."""

import datetime
import random

from regulith.plans import relational, streams, texts


def test_contamination_of_short_and_quoted_passages(spark, tmp_path):
    items = ["One two", "cat", "a b c", "he said so to all of us", "one two three four five six seven eight nine", "--", None, "eight words are in this one passage here"]
    docs = ['x "One two three four five six seven eight nine."', "concatenate a b c", "(he said so to all of us)", "none", None, "Eight words are in this one passage here.", "a\n\nb c -- cat"]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {i: (len(n), n[0]) for i, b in enumerate(items) if b is not None and (n := [k for k, t in enumerate(docs) if t and b.lower() in t.lower()])}
    got = {r.item_id: (r.docs, r.first_doc) for r in texts.contamination(spark, str(tmp_path)).collect()}
    assert got == want and len(want) == 7


def test_counter_of_files_in_reverse_order_of_time(spark, tmp_path):
    for k, days in enumerate((300, 200, 100, 0)):
        at = datetime.datetime(2024, 1, 1) + datetime.timedelta(days=days)
        rows = [(10 * k + i, at, i, "ab"[i % 2], 1.0, "{}") for i in range(6)]
        spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    got = {r.event_type: r.hit_count for r in streams.stream_idempotent_counter(spark, str(tmp_path)).collect()}
    assert got == {"a": 12, "b": 12}


def test_article_end_of_a_long_document(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(relational, "BLOCK", 4, raising=False)
    g = random.Random(2)
    rows = [(1 if i < 150 else 2 + i % 7, g.randrange(1000), datetime.date(2020, 1, 1) + datetime.timedelta(days=i)) for i in range(200)]
    spark.createDataFrame(rows, "o_custkey long, o_orderkey long, o_orderdate date").write.parquet(f"{tmp_path}/orders.parquet")
    want, by = {}, {}
    for c, no, _ in rows:
        by.setdefault(c, []).append(no)
    for c, nos in by.items():
        for i, no in enumerate(nos):
            want[c, i + 1] = next((j + 1 for j in range(i + 1, len(nos)) if nos[j] >= no), None)
    end = relational.article_end(spark, str(tmp_path))
    assert {(r.doc_id, r.pos): r.next_pos for r in end.collect()} == want
    # no list of a whole document is copied to each of its rows
    assert "posexplode" not in end._jdf.queryExecution().optimizedPlan().toString()
