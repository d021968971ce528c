"""What a Python task holds at once follows from its text."""

import pyarrow as pa

from regulith.operators import grouping, segment


def test_slices_are_bounded_and_whole():
    texts = ["é" * n for n in (1, 700, 0, 30, 5000, 2, 2, 2)] + [None] + ["x" * 90] * 200
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "t"])
    got = list(segment.slices([batch, batch.slice(0, 0)], 1, 1000))
    assert [r for b in got for r in b.column(1).to_pylist()] == texts
    # less than two limits, or one long text with less than a limit beside it
    assert len(got) > 10 and all(sum(len((t or "").encode()) for t in sorted(b.column(1).to_pylist(), key=lambda t: len(t or ""))[:-1]) < 2000 for b in got)


def test_units_by_slices(spark, monkeypatch):
    rows = [(i, f"Une phrase assez longue numéro {i}. Une autre phrase, plus longue encore {i}." if i % 5 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(tuple(r) for r in segment.units(df).collect())
    monkeypatch.setattr(segment, "SLICE", 150)
    assert want and sorted(tuple(r) for r in segment.units(df).collect()) == want == sorted((i, n, u, s) for i, t in rows for n, (u, s) in enumerate(segment.units_of(t), 1))


def test_first_statements_by_few_documents(spark, monkeypatch):
    rows = [(i, [(1, "A", f"La même phrase {i % 3}."), (2, "A", f"La même phrase {i % 3}."), (3, "B", None)] if i % 4 else []) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, items array<struct<seq:long,kind:string,text:string>>")
    monkeypatch.setattr(grouping, "AT_ONCE", 4)
    want = sorted((i, *x) for i, items in rows if items for x in grouping.first_of(*map(list, zip(*items, strict=True))))
    assert want and sorted(tuple(r) for r in grouping.keep_first(df, df["items"]).collect()) == want
