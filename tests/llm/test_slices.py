"""What operators of texts make of an Arrow batch does not grow with the batch."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from foliant.llm import language_id, secret_scan
from foliant.llm.common import slices

SCHEMA = pa.schema({"doc_id": pa.int64(), "text": pa.string(), "lang": pa.string(), "source": pa.string(), "n_chars": pa.int64()})
TEXT = "the old house near the river was sold last summer " * 200


class Docs:
    """A table whose mapInArrow runs here, over one batch."""

    columns, schema = SCHEMA.names, None

    def __init__(self, batch):
        self.batch, self.sparkSession = batch, self
        self.sparkContext = self
        self.given: list[pa.RecordBatch] = []

    def broadcast(self, value):
        self.value = value
        return self

    def mapInArrow(self, run, schema):  # noqa: N802
        self.given = list(run(iter([self.batch])))
        return self


def batch_of(rows):
    return pa.RecordBatch.from_pylist(rows, SCHEMA)


def documents(n):
    return batch_of([{"doc_id": i, "text": None if i % 7 == 3 else f"{TEXT} {i}", "lang": None if i % 2 else "en", "source": "a", "n_chars": 1} for i in range(n)])


def model(langs=("de", "en")):
    return language_id.LanguageModel([(x, g, 3 + i, 0) for i, x in enumerate(langs) for g in ("<t", "th", "he", "e>", "<th", "the", f"q{i}")])


@pytest.mark.parametrize("size", [1, 5_000, 100_000, 1 << 30])
def test_slices_are_the_batches(size):
    batches = [documents(30), documents(0), documents(1)]
    got = list(slices(iter(batches), size))
    assert pa.Table.from_batches(got).equals(pa.Table.from_batches(batches))
    assert all(x.num_rows == 1 or x.nbytes <= 1.5 * size for x in got)


def test_pipeline_steps_give_back_slices_of_a_large_batch():
    docs = documents(900)
    kept = Docs(docs)
    language_id.keep_known(kept, model(), least=0.0)
    masked = Docs(docs)
    secret_scan.mask_secrets(masked, chars_col="n_chars")
    for given in (kept.given, masked.given):
        assert docs.nbytes > 3 * max(x.nbytes for x in given)
    assert pa.Table.from_batches(masked.given).equals(pa.Table.from_batches([docs]))
    assert pa.Table.from_batches(kept.given)["doc_id"].to_pylist() == [i for i in range(900) if i % 7 != 3]


def test_new_words_are_learned_in_parts():
    langs = [f"l{i:02d}" for i in range(40)]
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(30_000)]
    labeller = language_id.Labeller(model(langs))
    tracemalloc.start()
    try:
        labeller.label_all([" ".join(words[i : i + 100]).encode() for i in range(0, len(words), 100)])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # the n-grams of all words at once would take 18 numbers a word and language: 173 MB
    assert peak < 100e6
    known = np.array([labeller.vectors[labeller.words[w]] for w in words[-50:]])
    assert (known == labeller.model.words(words[-50:])).all()
