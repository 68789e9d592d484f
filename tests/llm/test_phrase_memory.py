"""What a task of the phrase collocations holds and sends at a time, however large its input is."""

import random
from unittest.mock import MagicMock

import numpy as np
import pyarrow as pa
from pyspark import Broadcast

from kairoscope.llm import collocations

READ_ROWS = 4096  # spark.sql.parquet.columnarReaderBatchSize


def in_worker(monkeypatch, make, *args):
    """The function that ``make`` runs in Python workers."""
    functions, table = MagicMock(), MagicMock()
    functions.col.return_value.__ge__ = lambda *_: functions
    monkeypatch.setattr(collocations, "F", functions)
    make(table, *args)
    return table.mapInArrow.call_args_list[0].args[0]


def told(bits):
    return MagicMock(value=bits)


def test_words_of_all_languages_are_bounded(monkeypatch):
    monkeypatch.setattr(collocations, "KNOWN_WORDS", 1000)
    read, want = [0], {}

    def batches():
        for n in range(40):
            words = [f"w{n}x{i}" for i in range(500)]
            want.update(dict.fromkeys(words, 2))
            read[0] += len(words)
            yield pa.RecordBatch.from_arrays([pa.array([f"l{n % 20}"]), pa.array([" ".join(words * 2)])], ["lang", "text"])

    got, held = {}, 0
    for batch in in_worker(monkeypatch, collocations.count_words, 0)(batches()):
        held = max(held, read[0] - len(got))
        got.update(zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True))
    assert got == want
    assert held < 3000  # of 20,000


def test_words_leave_in_small_batches(monkeypatch):
    text = " ".join(f"w{n}" for n in range(150_000))
    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([text])], ["lang", "text"])
    sent = [b.num_rows for b in in_worker(monkeypatch, collocations.count_words, 0)(iter([batch]))]
    assert sum(sent) == 150_000 and max(sent) <= 1 << 16


def test_a_reader_holds_few_coded_words(monkeypatch):
    text = ". ".join(["one two three four five"] * 60_000)
    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([text])], ["lang", "text"])
    every = told(np.full(1, 2**64 - 1, np.uint64))
    rows = [x for b in in_worker(monkeypatch, collocations.code_words, 0, every)(iter([batch])) for x in b.column(0).to_pylist()]
    assert sum(map(len, rows)) == 6 * 60_000 and all(x[-1] == 0 for x in rows)
    assert READ_ROWS * 8 * max(map(len, rows)) < 32 << 20


def test_phrases_leave_in_small_batches(monkeypatch):
    rng = random.Random(3)
    ids = np.array([0 if rng.random() < 0.1 else rng.getrandbits(40) + 1 for _ in range(1_500_000)], np.uint64)
    ids[-1] = 0
    ends = np.flatnonzero(ids == 0)[::50] + 1
    rows = pa.ListArray.from_arrays(pa.array(np.unique([0, *ends, len(ids)]).astype(np.int32)), pa.array(ids.view(np.int64)))
    batches = [pa.RecordBatch.from_arrays([rows.slice(n, 100)], ["ids"]) for n in range(0, len(rows), 100)]
    every = told(np.full(1, 2**64 - 1, np.uint64))
    sent = list(in_worker(monkeypatch, collocations.grow, 2, (every, None), None)(iter(batches)))
    assert sum(b.num_rows for b in sent) == ((ids[1:] != 0) & (ids[:-1] != 0)).sum()
    assert max(b.nbytes for b in sent) < 4 << 20
    sent = list(in_worker(monkeypatch, collocations.enclosed, {2: every})(iter(batches)))
    assert max(b.nbytes for b in sent) < 4 << 20


def test_bitmaps_are_dropped_when_they_were_read(spark, monkeypatch):
    kept, context = set(), type(spark.sparkContext)
    broadcast, destroy = context.broadcast, Broadcast.destroy

    def noted(self, value):
        made = broadcast(self, value)
        kept.add(made._jbroadcast.id())
        return made

    monkeypatch.setattr(context, "broadcast", noted)
    monkeypatch.setattr(Broadcast, "destroy", lambda self, *a: (kept.discard(self._jbroadcast.id()), destroy(self, *a))[1])
    rows = [("en", f"p{i} q{i} r{j}") for i in range(5) for j in range(100)]
    found = collocations.collocations(spark.createDataFrame(rows, "lang string, text string"), top=3)
    assert not kept
    assert found.count() == 3
