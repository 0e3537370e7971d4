import base64
import quopri

from pyspark.sql import functions as F

from loglattice.llm import language, mails

EN = "We should move the meeting to Friday because the train ticket will not be ready before then. The team wants to talk about the old invoice and nobody objects."
DE = "Wir sollten die Besprechung auf Freitag verschieben, weil die Fahrkarte vorher nicht fertig sein wird. Das Wetter war die ganze Woche schlecht und niemand ist gegangen."
FR = "Nous devrions reporter la réunion à vendredi, parce que le billet de train ne sera pas prêt avant. Il a fait mauvais toute la semaine, donc personne n'est sorti."
RU = "Мы должны перенести встречу на пятницу, потому что билет на поезд не будет готов раньше. Всю неделю была плохая погода, и никто не выходил."
HEAD = "From: A B <a@b.test>\nSubject: Die Rechnung\nContent-Type: text/plain; charset={}\nContent-Transfer-Encoding: {}\n\n"


def test_own_prose():
    body = f"Hi,\n\n{EN}\n\nOn 25.10.2024 17:59, Nyjor Jor wrote:\n> {DE}\n>> {FR}\n\nThanks\n-- \nA B\nRing Office\n\n____________\n{DE}\n"
    want = ["Hi,", EN, "Thanks"]
    plain = HEAD.format("utf-8", "8bit") + body
    coded = HEAD.format("iso-8859-1", "base64") + base64.encodebytes(body.encode("latin-1")).decode()
    quoted = HEAD.format("iso-8859-1", "quoted-printable") + quopri.encodestring(body.encode("latin-1")).decode()
    parts = "From: A\nContent-Type: multipart/mixed;\n\tboundary=\"=_x\"\n\n--=_x\n" + "\n".join(plain.split("\n")[2:]) + "\n--=_x\nContent-Type: text/html\n\n<p>" + DE + "</p>\n--=_x\nContent-Type: text/plain\nContent-Disposition: attachment; filename=a\n\n" + DE + "\n--=_x--\n"
    for text in (plain, coded, quoted, parts, plain.replace("\n", "\r\n"), "From a@b.test Sun Jun 1 00:00:00 2024\n" + plain, body):
        assert [x for x in mails.prose_lines(text) if x.strip()] == want, text[:60]
    assert mails.prose_lines(None) == mails.prose_lines("") == mails.prose_lines(" \n ") == []
    only_html = "Content-Type: text/html; charset=utf-8\n\n<html><body><p>Bonjour &amp; merci,<br>\nOn 25.10.2024 17:59, A B wrote:<br>\n&gt; Hello</p></body></html>"
    assert "Bonjour & merci," in "\n".join(mails.prose_lines(only_html)) and "Hello" not in "\n".join(mails.prose_lines(only_html))


def model():
    counts = {}
    for code, text in (("en", EN), ("de", DE), ("fr", FR), ("ru", RU)):
        for w in language.own_words(text)[0]:
            counts[language.folded(w), code] = counts.get((language.folded(w), code), 0) + 50
    return language.fitted(counts)


def test_labels_and_segments(spark):
    texts = [(1, EN, "en"), (2, DE, "EN"), (3, f"{EN}\n\n{DE}", "en"), (4, None, "en"), (5, "", None), (6, " ", "de"), (7, RU, "ru-RU"), (8, FR + " " + EN, "fr"), (9, "東港倉庫 95号 123", "en"), (10, EN + " Guten.", "English"), (11, (EN + " ") * 400, "eng"), (12, FR, None)]
    df = spark.createDataFrame([(i, t, lang, "x") for i, t, lang in texts], "doc_id int, text string, lang string, segments string")
    segmented = language.with_segments(df, model()).cache()
    assert segmented.count() == len(texts)
    got = sorted(map(tuple, language.label_cases(segmented).collect()))
    assert got == [(2, "de"), (3, "de"), (3, "en"), (8, "en"), (8, "fr"), (12, "fr")]
    shares = {(r["doc_id"], r["lang"]): r for r in language.languages(segmented).collect()}
    assert 0.4 < shares[3, "de"]["share"] < 0.6 and all(0 < r["confidence"] <= 1 for r in shares.values()) and shares[1, "en"]["confidence"] > 0.7
    cut = segmented.where("doc_id = 3").select(F.explode("segments").alias("s")).select("s.*").collect()
    assert [(r["lang"], r["start"]) for r in cut] == [("en", 0), ("de", len(language.own_words(EN)[0]))]
    assert language.label_cases(language.with_segments(df.limit(0), model())).count() == 0


def test_names_of_languages(spark):
    labels = ["en", "EN", "en_GB", "en-US", "English", "deutsch", "ger", "Français", "pt-BR", "", " ", None, "xx", "und", "unknown", "-", "english-ish", "Русский"]
    df = spark.createDataFrame([(x,) for x in labels], "lang string")
    got = [r[0] for r in df.select(language.named_language(F.col("lang"))).collect()]
    assert got == ["en", "en", "en", "en", "en", "de", "de", "fr", "pt", None, None, None, None, None, None, None, None, "ru"]


def test_viterbi_equals_trying_all_paths():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    scores = [rng.normal(size=(n, len(language.LANGS))).astype(np.float32) * 3 for n in (1, 2, 3, 0, 4)]
    starts = [[True] + [bool(x) for x in rng.integers(0, 2, max(0, len(s) - 1))] for s in scores]
    got = language.viterbi(scores, starts, inner=2.0, between=1.0, cells=8)
    for s, st, path in zip(scores, starts, got):
        if len(s):
            cost = lambda p: sum(s[i, k] for i, k in enumerate(p)) - sum((1.0 if st[i] else 2.0) for i in range(1, len(p)) if p[i] != p[i - 1])
            best = max(cost(p) for p in itertools.product(range(len(language.LANGS)), repeat=len(s)))
            assert abs(cost(path) - best) < 1e-4
        assert len(path) == len(s)


def test_held_out_labels(spark):
    import os

    import pytest

    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    fitted = language.fit(docs.where("doc_id % 2 = 0"), sample=300)
    found = language.languages(language.with_segments(docs.where("doc_id % 2 = 1"), fitted)).groupBy("doc_id", "label").agg(F.collect_set("lang").alias("l"), F.min("confidence").alias("c"))
    known = found.where("label is not null and size(l) = 1")
    right = known.where(F.col("label") == F.col("l")[0]).count()
    assert right / known.count() > 0.85  # about a tenth of the labels is wrong
    assert language.fit(docs.limit(0)).row("house").max() == 0


def test_mails_nested_in_mails():
    text = "Content-Type: text/plain\n\n" + EN + "\n"
    for k in range(300):
        text = f"Content-Type: multipart/mixed; boundary=\"=_{k}_\"\n\n--=_{k}_\n{text}\n--=_{k}_--\n"
    assert [x for x in mails.prose_lines("From: A\n" + text) if x.strip()] == [EN]


def test_all_words_of_the_sample_count(spark):
    """A model of more words than any list of the most frequent ones would keep."""
    letters = "abcdefghijklmnopqrst"
    word = lambda i: "".join(letters[(i // 20**k) % 20] for k in range(4))
    rows = [(n, " ".join(word(i) for i in range(n * 1000, n * 1000 + 1000)), "en" if n % 2 else "de") for n in range(70)]
    fitted = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=1000)
    assert len(fitted.words) == 70_000
