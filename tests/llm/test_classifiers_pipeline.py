import random
import zlib

import pytest

import corpus_pipeline
from replicalog.llm import quality_classifier, toxicity

from . import brute


def words(draw, n):
    return " ".join("".join(draw.choices(["ka", "ro", "mi", "te", "su", "ne", "la"], k=draw.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    draw = random.Random(11)
    rows = []
    for i in range(600):
        w = words(draw, draw.randint(20, 80)).split()
        good, toxic = i % 4 != 0, i % 3 == 0
        if toxic:
            for _ in range(3):
                w.insert(draw.randrange(len(w)), draw.choice(["vilefool", "vilefish", "Oafish!", "oafish"]))
        rows.append((i, " ".join(w) + "." if good else " ".join(x + draw.choice(["###", "$$$", "%%%"]) for x in w), int(good), int(toxic)))
    docs = spark.createDataFrame([(i, t, "xx", "s", len(t)) for i, t, _, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in rows] + [(9999, None, None)], "doc_id long, quality int, toxic int")
    return docs, labels, rows


@pytest.mark.parametrize(("op", "column"), [(quality_classifier.score, 2), (toxicity.score, 3)])
def test_held_out_accuracy(spark, labelled, op, column):
    docs, labels, rows = labelled
    got = {r.doc_id: r for r in op(docs, labels).collect()}
    out = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert {r[0] for r in out} == {i for i, r in got.items() if r.held_out}
    assert sum(got[r[0]].predicted == r[column] for r in out) >= 0.97 * len(out)


@pytest.mark.parametrize("op", [quality_classifier.score, toxicity.score])
def test_held_out_labels_are_never_read(spark, labelled, op):
    docs, labels, _ = labelled
    lies = labels.selectExpr("doc_id", *(f"IF(crc32(CAST(doc_id AS STRING)) % 3 = 1, 1 - {c}, {c}) AS {c}" for c in ("quality", "toxic")))
    assert sorted(op(docs, labels).collect()) == sorted(op(docs, lies).collect())


@pytest.mark.parametrize("op", [quality_classifier.score, toxicity.score])
def test_odd_rows(spark, labelled, op):
    _, labels, _ = labelled
    odd = brute.odd_docs(spark)
    nothing = spark.createDataFrame([], labels.schema)
    assert [r.score for r in op(odd, nothing).collect()] == [0.5] * len(brute.ODD_TEXTS)
    docs = labelled[0].unionByName(odd.selectExpr("doc_id + 1000 AS doc_id", "text", "lang", "source", "n_chars"))
    rows = op(docs, labels).collect()
    assert len(rows) == 600 + len(brute.ODD_TEXTS) and all(0 <= r.score <= 1 for r in rows)
    assert op(spark.createDataFrame([], odd.schema), labels).count() == 0


def test_votes_against_brute_force(spark, labelled):
    """Every score from all cosines, sorted; equal ones in the sample's order. The sample holds texts more than once."""
    import numpy as np

    docs, labels, rows = labelled
    twice = docs.unionByName(docs.where("doc_id < 200").selectExpr("doc_id + 5000 AS doc_id", "text", "lang", "source", "n_chars"))
    more = labels.unionByName(labels.where("doc_id < 200").selectExpr("doc_id + 5000 AS doc_id", "1 - quality AS quality", "toxic"))
    space = quality_classifier.fitted(twice, more)
    unit = lambda x: x / max(np.linalg.norm(x), 1e-30)
    got = {r.doc_id: r.score for r in quality_classifier.score(twice, more).collect()}
    tied = 0
    for i, t, _, _ in rows[:150]:
        latent = unit(unit(quality_classifier.terms(t) * space.weight) @ space.basis)
        cosine = np.array([latent @ v for v in space.vectors], dtype=np.float32)
        order = sorted(range(len(cosine)), key=lambda k: (-round(float(cosine[k]), 5), k))
        k = quality_classifier.NEIGHBOURS
        tied += round(float(cosine[order[k - 1]]), 5) == round(float(cosine[order[k]]), 5)
        w = np.maximum(cosine[order[:k]], 0) ** 8
        assert round(float(cosine[order[k - 1]]), 5) == round(float(cosine[order[k]]), 5) or abs((w * space.labels[order[:k]]).sum() / w.sum() - got[i]) < 1e-3
    assert len(space.vectors) <= 2 * quality_classifier.PER_CLASS


def test_equal_cosines_go_by_the_samples_order():
    import numpy as np

    rows = np.eye(4, dtype=np.float32)[[0] * 20 + [1] * 20 + [2] * 5]
    space = quality_classifier.Space(rows, np.array([1.0] * 15 + [0.0] * 5 + [0.0] * 15 + [1.0] * 5 + [1.0] * 5))
    assert np.allclose(space.scores(np.eye(4, dtype=np.float32)[[0, 1]]), [1.0, 0.0], atol=1e-6)


def test_toxic_offsets(spark, labelled):
    docs, labels, rows = labelled
    texts = {r[0]: r[1] for r in rows}
    for r in toxicity.score(docs, labels).collect():
        for span in filter(None, r.spans.split(",")):
            a, b = map(int, span.split(":"))
            assert any(x in texts[r.doc_id][a:b].lower() for x in ("vile", "oafish"))


def enumerated(e, t):
    """Marginals, expected moves and log of the partition sum, over all taggings."""
    import itertools

    import numpy as np

    total, on, moves = 0.0, np.zeros(len(e)), np.zeros((2, 2))
    for y in itertools.product((0, 1), repeat=len(e)):
        pairs = list(zip(y, y[1:]))  # noqa: B905
        w = np.exp(sum(a for a, s in zip(e, y, strict=True) if s) + sum(t[a, b] for a, b in pairs))
        total, on = total + w, on + w * np.array(y)
        for a, b in pairs:
            moves[a, b] += w
    return on / total, moves / total, np.log(total)


def test_expectations_against_enumeration(monkeypatch):
    import numpy as np

    draw = np.random.default_rng(4)
    for at_once in (1, 7, 1000):
        monkeypatch.setattr(toxicity, "AT_ONCE", at_once)
        t = draw.normal(size=(2, 2))
        e = [draw.normal(size=n) for n in (1, 5, 3, 0, 5, 2)]
        got, moves = toxicity.expectations(e, t, moves=True)
        want = [enumerated(x, t) for x in e]
        assert all(np.allclose(g, w[0]) for g, w in zip(got, want, strict=True))
        assert np.allclose(moves, sum(w[1] for w in want))


def test_gradient_against_finite_differences():
    """Held less expected moves is the slope of the conditional log-likelihood."""
    import numpy as np

    draw = np.random.default_rng(6)
    e, t, y = draw.normal(size=6), draw.normal(size=(2, 2)), [0, 1, 1, 0, 0, 1]
    like = lambda t: sum(x for x, s in zip(e, y, strict=True) if s) + sum(t[a, b] for a, b in zip(y, y[1:])) - enumerated(e, t)[2]  # noqa: E731, B905
    held = np.zeros((2, 2))
    np.add.at(held, (np.array(y[:-1]), np.array(y[1:])), 1)
    slope = held - toxicity.expectations([e], t, moves=True)[1]
    for a in (0, 1):
        for b in (0, 1):
            d = np.zeros((2, 2))
            d[a, b] = 1e-5
            assert abs((like(t + d) - like(t - d)) / 2e-5 - slope[a, b]) < 1e-6


def test_moves_are_learned():
    """In training data whose marks come in pairs a second mark is likelier after a first."""
    draw = random.Random(5)
    rows = []
    for i in range(400):
        w = words(draw, 12).split()
        if i % 2:
            k = draw.randrange(9)
            w[k : k + 2] = [draw.choice(["vilefool", "vilefish"]), draw.choice(["oafish", "oafling"])]
        rows.append((" ".join(w) + ".", i % 2))
    chain = toxicity.Chain(rows)
    t = chain.moves
    assert t[0, 0] + t[1, 1] > t[0, 1] + t[1, 0]
    assert chain.score(chain.tagged(["ka ro vilefool oafish mi."])[0]) > 0.7 > chain.score(chain.tagged(["ka ro mi te."])[0])


def test_very_long_sentences():
    """A million words without a full stop, beside short texts, in little memory."""
    import tracemalloc

    draw = random.Random(3)
    chain = toxicity.Chain([(words(draw, 20) + (" vilefool." if i % 2 else "."), i % 2) for i in range(200)])
    tracemalloc.start()
    found = chain.tagged([" ".join(["ka ro vilefool mi te"] * 200_000), *["vilefool ka."] * 300])
    assert tracemalloc.get_traced_memory()[1] < 600e6 and len(found[0]) >= 200_000
    tracemalloc.stop()


def test_pipeline(spark, labelled, tmp_path):
    docs, labels, rows = labelled
    draw = random.Random(12)
    item, passage = words(draw, 30), words(draw, 60)
    near = words(draw, 100).split()
    extra = [(2000 + i, words(draw, 40) + "\n" + passage) for i in range(6)] + [(3000, words(draw, 20) + " " + item)]
    extra += [(4000 + i, " ".join([*near[: 20 * i], "zzz", *near[20 * i :]])) for i in range(3)]
    more = spark.createDataFrame([(i, t, "xx", "s", len(t)) for i, t in extra], docs.schema)
    docs.unionByName(more).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert 3000 not in got and {2000 + i for i in range(6)} <= set(got)
    assert [i for i in (4000, 4001, 4002) if i in got] == [4000]
    assert got[2001].n_tokens < got[2000].n_tokens
    clean = {r[0] for r in rows if r[2] == 1}
    assert len(clean - set(got)) <= 0.02 * len(clean) and not {r[0] for r in rows if r[2] == 0} & set(got)
    stage = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, f in corpus_pipeline.STAGES[:-1]:
        assert f(spark, stage, str(tmp_path)).columns == docs.columns
