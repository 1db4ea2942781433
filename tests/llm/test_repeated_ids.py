"""Near copies where one id stands beside different texts."""

import pyarrow as pa

from pairmill.llm import order_minhash
from pairmill.llm.order_minhash import LastRead, near_classes


def prose(name, changed=None):
    words = [f"{name}w{i}" for i in range(120)]
    if changed is not None:
        words[changed] = "changed"
    return " ".join(words)


def test_texts_of_one_id_are_compared_as_themselves(spark):
    """Each id has two texts, and each of them has a near copy under another id."""
    rows = []
    for i in range(6):
        rows += [(i, prose(f"a{i}")), (i, prose(f"b{i}"))]
        rows += [(100 + i, prose(f"a{i}", 60)), (200 + i, prose(f"b{i}", 60))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.id: r.class_id for r in near_classes(df).collect() if r.id >= 100}
    assert found == {base + i: i for i in range(6) for base in (100, 200)}


def test_texts_kept_for_comparison_are_bounded(monkeypatch):
    """A task of the full comparison keeps some words, not all texts that it has read, and reads a text again when needed."""
    monkeypatch.setattr(order_minhash, "KEPT_WORDS", 1000)
    texts = [prose(f"t{i}") for i in range(50)]
    read = LastRead(pa.array(texts))
    for number in [*range(50), 3, 49]:
        assert len(read[number].words) == 120
        assert sum(len(one.words) for one in read.kept.values()) == read.words <= 1000
    assert 49 in read.kept and 3 in read.kept and 0 not in read.kept
