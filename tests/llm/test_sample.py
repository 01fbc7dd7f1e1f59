"""The field's training sample covers all texts."""

import random

from heritree.llm import pii


def texts():
    """A text full of numbers first; secrets only in the last texts."""
    r = random.Random(8)
    key = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    plain = "; in between stand a few more words of text ; "
    first = plain.join(f"nr {r.randrange(10**6, 10**8)}" for _ in range(3000))
    return [first] + [plain.join(f"password={key(18)}" for _ in range(4)) for _ in range(60)]


def test_a_kind_that_occurs_late_is_learned():
    model = pii.train(texts())
    assert any(w[pii.LABELS.index("secret")] > 0 for w in model.weights.values())
    assert [k for k, *_ in model.spans("so password=0a1b2c3d4e5f6a7b8c and more")] == ["secret"]


def test_row_order_and_copies_change_nothing(spark):
    t = texts()
    weights = lambda model: {f: w.tolist() for f, w in model.weights.items()}
    expected = weights(pii.train(t))
    assert expected == weights(pii.train(t[::-1])) == weights(pii.train(t + t))
    frame = lambda x, n: spark.createDataFrame([(k, v) for k, v in enumerate(x)], "doc_id long, text string").repartition(n)
    for x, n in ((t, 1), (t[::-1] + t, 5)):
        assert weights(pii.fitted(frame(x, n))) == expected
