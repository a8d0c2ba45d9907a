import random

from replicalog.llm import pii, url_filter

from . import brute


def test_pii_base_against_brute_force(spark):
    draw = random.Random(3)
    pieces = ["a.b@x.org", "_c@d.e-f", "@", ".", " ", "  ", "-", "+", "+49 (30) 12-34.56 78", "4111111111111111", "4111-1111 1111 1111", "10.0.0.255", "1.2.3", "999.1.1.1", "7", "42", "é", "\n", "x", "%", "00", "1234567890123456789", "(", ")"]
    texts = [*brute.ODD_TEXTS, *("".join(draw.choices(pieces, k=draw.randint(1, 40))) for _ in range(400))]
    rows = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        counts, digest, joined = brute.pii_base(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts, (texts[r.doc_id], r)
        assert r.base_sha256 == digest, (texts[r.doc_id], r, joined)
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))


def test_pii_adds_written_out_addresses(spark):
    rows = [(i, f"write to bob{i}@mail{i}.example.com or call +1 (578) 555-64{i:02d} about card 4111111111111111") for i in range(20)]
    rows += [(100, "mail jane.doe [at] example [dot] com today"), (101, "call (578) 555-6437 now"), (102, "plain 2024 text 555")]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100].spans == "email:5:36" and got[100].n_email == 0 and got[100].n_added == 1
    assert got[101].spans == "phone:5:19"
    assert got[102].spans == "" and got[3].n_added == 0


def test_pii_secrets_and_accounts(spark):
    """Recall and precision on planted secrets and account numbers, beside hashes and names that are neither."""
    draw = random.Random(17)
    hex_ = lambda n: "".join(draw.choices("0123456789abcdef", k=n))
    rows = []
    for i in range(60):
        rows.append((i, f"some words\n{draw.choice(['token', 'api_key', 'secret', 'auth_token'])} = \"{hex_(draw.choice([32, 40]))}\" more words {i}"))
        rows.append((100 + i, f"Bank account DE89 3704 0044 0532 0130 00 of customer {i}, or GB82WEST12345698765432"))
        rows.append((200 + i, f"version{i} of module_name_{i}_for_testing_2024 in src/lib/part{i}/file and averyverylongword{i}"))
        rows.append((300 + i, f"nothing here but {i} plain words about rivers"))
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum("secret:" in got[i].spans for i in range(60)) >= 54 and sum(got[100 + i].spans.count("iban:") == 2 for i in range(60)) >= 54
    assert sum(got[200 + i].found for i in range(60)) <= 3 and not any(got[300 + i].found for i in range(60))


def test_pii_reliabilities():
    """Labelers of known reliability: posteriors follow Bayes' rule with about those."""
    import numpy as np

    draw = np.random.default_rng(5)
    truth = draw.random(20_000) < 0.3
    right = np.array([0.95, 0.9, 0.8, 0.7])
    votes = np.where((draw.random((20_000, 4)) < right) == truth[:, None], 1, -1)
    known, which, count = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    p = pii.reliabilities(known, count.astype(float))
    odds = np.log(0.3 / 0.7) + (known * np.log(right / (1 - right))).sum(axis=1)
    assert np.abs(p - 1 / (1 + np.exp(-odds)))[count > 20].max() < 0.15
    assert ((p[which.ravel()] > 0.5) == truth).mean() > 0.94


def test_pii_many_matches(spark):
    """More matches than are summed up in one go."""
    text = "é a@b.c " * 1000 + "1.2.3.4 " * 600
    r = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    counts, digest, joined = brute.pii_base(text)
    assert [r.n_email, r.n_ip] == counts[:2] == [1000, 600] and r.base_sha256 == digest and r.spans == joined


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://A.Example.NET/en/1?q#f", "http://x.net", "http://x.net/a", "ftp://example.com/de/x", "http://q.org/fr/9", "http://notexample.net/en/", "x://y://z/p"]
    rows = [(i, u, "h") for i, u in enumerate(urls)] * 2
    got = url_filter.parts(spark.createDataFrame(rows, "page_id long, url string, host string")).distinct().collect()
    said = {r.page_id: (r.host, r.path, r.rule, r.ruled) for r in got}
    assert said[0] == said[1] == said[2] == ("", "", None, None)
    assert said[3] == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert said[4] == ("x.net", "", None, None) and said[5] == ("x.net", "/a", "net/", "block")
    assert said[6][2:] == ("example.com/de/", "block") and said[7][2:] == ("org/fr/", "allow")
    assert said[8][2] == "net/" and said[9][:2] == ("y:", "//z/p")
    assert url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, host string")).count() == 20
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_models_tell_classes_apart(spark):
    draw = random.Random(1)
    word = lambda letters: "".join(draw.choices(letters, k=8))
    rows = [(i, f"http://{word('abcd')}.a.org/fr/{word('abcd')}") for i in range(150)] + [(200 + i, f"http://{word('wxyz')}.a.net/{word('wxyz')}") for i in range(150)]
    rows += [(500, "http://abcdabcd.a.com/fr/badcabad"), (501, "http://wxzyxzyw.a.com/zzyxwxyz"), (502, None)]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert len(got) == 303
    assert got[500].verdict == "allow" and got[500].rule is None
    assert got[501].verdict == "block" and got[501].score < got[500].score


def test_url_scores_against_brute_force(spark):
    """The smoothed probabilities, by hand, of texts under both models."""
    texts = [("ab/ab", 1), ("abc", 1), ("ba", 0), ("cab/", 0), ("ab/ab", 1)]
    model = url_filter.train(spark.createDataFrame([(t, y, 1) for t, y in texts], "m string, label int, n long"))
    order = url_filter.ORDER
    grams = lambda t: [(p, k) for p in range(order, order + len(t) + 1) for k in range(order + 1)]
    import math
    from collections import Counter

    count = {0: Counter(), 1: Counter()}
    for t, y in texts:
        s = "^" * order + t + "$"
        count[y].update(s[p - k : p + 1] for p, k in grams(t))

    def prob(y, gram):
        if not gram:
            return 1 / url_filter.ALPHABET
        following = {g: n for g, n in count[y].items() if g[:-1] == gram[:-1] and len(g) == len(gram)}
        total, kinds, lower = sum(following.values()), len(following), prob(y, gram[1:])
        return (count[y][gram] + kinds * lower) / (total + kinds) if total else lower

    for t in ["ab/ab", "cabc", "zz", ""]:
        s = "^" * order + t + "$"
        want = sum(math.log(prob(1, s[p - order : p + 1])) - math.log(prob(0, s[p - order : p + 1])) for p in range(order, order + len(t) + 1)) / (len(t) + 1)
        got = url_filter._scored(spark.createDataFrame([(t,)], "m string"), model).first().score
        assert abs(got - want) < 1e-9, t


def test_url_models_keep_every_gram(spark, monkeypatch):
    """With a bound far below the inventory the models and scores stay as they are."""
    draw = random.Random(8)
    texts = [("".join(draw.choices("abcde/", k=12)), i % 2, 1 + i % 3) for i in range(40)]
    labelled, asked = spark.createDataFrame(texts, "m string, label int, n long"), spark.createDataFrame([(t,) for t, _, _ in texts], "m string").distinct()

    def scored():
        model = url_filter.train(labelled)
        return model.where("d IS NOT NULL").select("gram").distinct().count(), {r.m: round(r.score, 9) for r in url_filter._scored(asked, model).collect()}

    padded = ["^" * url_filter.ORDER + t + "$" for t, _, _ in texts]
    grams = {s[p - k : p + 1] for s in padded for p in range(url_filter.ORDER, len(s)) for k in range(url_filter.ORDER + 1)}
    free = scored()
    monkeypatch.setattr(url_filter, "MAX_GRAMS", 10)
    assert free[0] == len(grams) and scored() == free


def test_url_cut_against_brute_force(spark):
    """The largest cut of all in hundredths that lets enough of the accepted examples pass."""
    draw = random.Random(31)
    rows = [(draw.gauss(0.3 if y else -0.2, 0.3), y, draw.randint(1, 4)) for y in (0, 1) for _ in range(200)]
    cut = url_filter._calibrated(spark.createDataFrame(rows, "score double, label int, n long"))
    good = sum(n for _, y, n in rows if y)
    enough = [c / 100 for c in range(-300, 300) if sum(n for s, y, n in rows if y and s >= c / 100) >= url_filter.ACCEPTED * good]
    assert abs(cut - max(enough)) < 0.0100001


def test_url_seed_words_are_learned_and_languages_are_not(spark):
    """Hosts like those with a seed word are blocked where no rule decides, others are allowed whatever their language."""
    draw = random.Random(33)
    name = lambda: "".join(draw.choices(["th", "er", "on", "in", "an"], k=3))
    rows = [(i, f"https://{name()}.example.{draw.choice(['net', 'org'])}/{draw.choice(['en', 'fr', 'de', 'es'])}/{i}") for i in range(600)]
    rows += [(1000 + i, f"https://casino-{name()}.example.com/en/{i}") for i in range(60)]
    plain = [(2000 + i, f"https://{name()}.example.com/{lang}/{i}") for i, lang in enumerate(["en", "fr", "es"] * 20)]
    like = [(3000 + i, f"https://casin0-{name()}.example.com/en/{i}") for i in range(20)]
    got = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(rows + plain + like, "page_id long, url string")).collect()}
    assert sum(got[i] == "block" for i, _ in like) >= 18 and sum(got[i] == "allow" for i, _ in plain) >= 54


def test_url_models_read_the_names_of_domains(spark):
    hosts = {"http://casino-pills.biz/a/1": "casino-pills./1", "http://nicehost.biz/a/1": "nicehost./1", "http://www.x.org/a/1": "www.x./1", "http://net/a/1": "/1", "http://a.example.com/de/2": "a.example./2", "http://b.planet/q": "b."}
    parts = url_filter.parts(spark.createDataFrame(list(enumerate(hosts)), "page_id long, url string"))
    assert {r.url: r.m for r in parts.select("url", url_filter._read().alias("m")).collect()} == hosts
    rows = [f"http://{w}{k}.org/fr/page/{k}" for k in range(30) for w in ("garden", "museum")] + [f"http://{w}{k}.biz/x/page/{k}" for k in range(30) for w in ("cheappills", "casino-win")]
    asked = ["http://pillcheap.biz/x/page/7", "http://winsino.biz/x/page/7"]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(list(enumerate(rows + asked)), "page_id long, url string")).collect()}
    assert len({got[len(rows) + k].score for k in range(2)}) == 2 and all(got[len(rows) + k].verdict == "block" for k in range(2))
