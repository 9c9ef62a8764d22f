import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.config import Settings
from millrace.functions import boundaries as B
from millrace.operators import index
from millrace.sources import files as S

STARTS = ["The", "It", "We"]


def say(draw, abbreviation):
    """Sentences in which an abbreviation stands before names, some at the end of one."""
    names, words = ["Meyer", "Lopez", "Brandt", "Okafor"], [f"word{chr(97 + i)}" for i in range(26)]
    out = []
    for _ in range(draw.randint(3, 8)):
        body = [draw.choice(STARTS), *draw.choices(words, k=draw.randint(3, 7))]
        if draw.random() < 0.5:
            body.insert(2, f"{abbreviation} {draw.choice(names)}")
        out.append(" ".join(body) + draw.choice([".", ".", ".", "!", "?"]))
    return draw.choice([" ", "  ", "\n"]).join(out)


@pytest.fixture(scope="module")
def corpus(spark):
    draw = random.Random(2)
    rows = [(i, say(draw, "Dr."), "en") for i in range(150)] + [(1000 + i, say(draw, "Hr."), "de") for i in range(100)] + [(2000, None, "en"), (2001, "", "en"), (2002, " . ", None), (2003, "e.g. this. No. 7 is odd.", "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4).cache()


@pytest.fixture(scope="module")
def model(corpus):
    return B.learn(corpus).cache()


def brute_tokens(text):
    words = (text or "").split()
    bare = [re.sub(r"^[\W_]+|[^\w.]+$", "", w).lower() for w in words]
    kind = lambda b: "##" if re.fullmatch(r"[\d.,]+", re.sub(r"\.$", "", b) or "x") else re.sub(r"\.$", "", b)
    for k, (w, b) in enumerate(zip(words, bare)):
        mark = re.search(r"([.!?])[^\w.!?]*$", w)
        if kind(b):
            yield kind(b), b.endswith("."), mark and mark[1], kind(bare[k + 1]) if k + 1 < len(bare) else ""


def log_l(k, n, p):
    return (k * math.log(p) if k else 0.0) + ((n - k) * math.log(1 - p) if n - k else 0.0)


def brute_model(rows):
    out = {}
    for lang in {r["lang"] or "" for r in rows}:
        tokens = [t for r in rows if (r["lang"] or "") == lang for t in brute_tokens(r["text"])]
        n, dots = Counter(t[0] for t in tokens), Counter(t[0] for t in tokens if t[1])
        whole, periods = sum(n.values()), sum(dots.values())
        short = set()
        for t in dots:
            if t == "##" or not re.search(r"[^\W\d_]", t):
                continue
            letters = len(t.replace(".", ""))
            ratio = -2 * (log_l(dots[t], n[t], periods / whole) - log_l(dots[t], n[t], 0.99))
            score = ratio * math.exp(-letters) * (len(t) - letters + 1) * letters ** -(n[t] - dots[t])
            if score >= 0.3:
                short.add(t)
                out[lang, "abbreviation", t, None] = score
        pairs = Counter((t[2], t[0], t[3]) for t in tokens if t[2] and t[3])
        loose = lambda t: t in short or len(t) == 1 or t == "##"

        def ratio(c1, c2, c12, whole=whole):
            return -2 * (log_l(c12, c1, c2 / whole) + log_l(c2 - c12, whole - c1, c2 / whole) - log_l(c12, c1, c12 / c1) - log_l(c2 - c12, whole - c1, (c2 - c12) / (whole - c1)))

        ends = Counter()
        for (mark, t, after), c in pairs.items():
            if mark != "." or not loose(t):
                ends[after] += c
        c1 = sum(ends.values())
        for t, c12 in ends.items():
            if re.match(r"[^\W\d_]", t) and c12 * whole > c1 * n[t] and ratio(c1, n[t], c12) >= 30:
                out[lang, "starter", t, None] = ratio(c1, n[t], c12)
        for (mark, t, after), c12 in pairs.items():
            if mark == "." and loose(t) and c12 > 1 and c12 * whole > n[t] * n[after] and ratio(n[t], n[after], c12) >= 7.88:
                out[lang, "collocation", t, after] = ratio(n[t], n[after], c12)
    return out


def test_statistics_against_brute_force(corpus, model):
    found = {(r["lang"], r["kind"], r["term"], r["other"]): r["score"] for r in model.collect()}
    want = brute_model(corpus.collect())
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k], rel=1e-9, abs=1e-9) for k in want)
    assert ("en", "abbreviation", "dr", None) in found and ("de", "abbreviation", "hr", None) in found and ("de", "abbreviation", "dr", None) not in found
    assert {t.lower() for t in STARTS} <= {k[2] for k in found if k[:2] == ("en", "starter")}


def cut(spark, corpus_model, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return {r["doc_id"]: r["sentences"] for r in B.sentences(docs, corpus_model).collect()}


def test_abbreviations_split_no_more_but_before_a_starter(spark, model):
    rows = [(1, "It saw Dr. Meyer wordb. The end!  It went?\nYes", "en"), (2, "It saw Hr. Meyer wordb. The end.", "en"), (3, "We met the Dr. The end.", "en"), (4, "It saw Hr. Meyer wordb. The end.", "de"), (5, "It saw Dr. Meyer.  The end.", "xx"), (6, None, "en"), (7, " \n", "en"), (8, "No marks", None)]
    found = cut(spark, model, rows)
    assert found[1] == ["It saw Dr. Meyer wordb.", "The end!", "It went?", "Yes"]
    assert found[2] == ["It saw Hr.", "Meyer wordb.", "The end."] and found[4] == ["It saw Hr. Meyer wordb.", "The end."]
    assert found[3] == ["We met the Dr.", "The end."] and found[5] == ["It saw Dr.", "Meyer.", "The end."]
    assert found[6] == [] and found[7] == [] and found[8] == ["No marks"]


def test_a_sentence_stays_as_written(spark, model):
    found = cut(spark, model, [(1, "It saw Dr.\n Meyer  word. The end.", "en"), (2, "On 7. maj. it rained. 8. Then", "en")])
    assert found[1] == ["It saw Dr.\n Meyer  word.", "The end."]
    assert found[2][0].startswith("On 7. maj.")


def test_data_language_decides_in_a_refresh(spark, model, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("It saw Dr. Meyer there. The end.")
    for language, first in (("en", "It saw Dr. Meyer there."), ("de", "It saw Dr.")):
        store = index.Store(spark, str(tmp_path / language))
        index.refresh(store, S.scan_files(spark, str(folder)), S.read_blocks, "c", Settings(chunk_size=1, overlap_size=0, data_language=language), model=model)
        assert store.chunks("c").orderBy("chunk_id").first()["document"] == first


def test_no_texts_and_models_that_are_not_sent(spark, corpus, model):
    assert B.learn(corpus.limit(0)).count() == 0
    rows = lambda df: sorted((r["doc_id"], r["sentences"]) for r in df.collect())
    assert rows(B.sentences(corpus, model)) == rows(B.sentences(corpus, model, broadcast_terms=0))
    odd = corpus.withColumns({c: F.lit("x") for c in ("abbreviation", "kind", "term", "type")})
    assert rows(B.sentences(odd, B.learn(odd))) == rows(B.sentences(corpus, model))


def test_patterns_are_worked_out_once_a_different_token(spark):
    rows = spark.createDataFrame([("the cat sat. The dog!", "en")] * 300, "text string, lang string").repartition(3)
    found = {(r["w"], r["after"]): r["n"] for r in B.occurrences(rows).collect()}
    assert found == {("the", None): 300, ("cat", None): 300, ("sat.", "The"): 300, ("The", None): 300, ("dog!", None): 300}


def test_texts_are_cut_in_tasks_as_by_the_expression(spark, monkeypatch):
    draw = random.Random(6)
    bits = ["Dr.", "dr.", "ΟΔΟΣ.", "The", "the", "Meyer", "7.", "No.", "3,5.", "x.", "É.", "\"Dr.", "(etc.)", "...", "?!", "a.b.", "No.!", "end!", "was?", "-", "²", "日本。", "𝒳."]
    gaps = [" ", " ", " ", "  ", "\n", "\t", "\x1c", "\x1f ", "\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u202f", "\u205f", "\u3000", "\u200b", "", "\r\n", "\x00"]
    texts = ["".join(draw.choice(bits) + draw.choice(gaps) for _ in range(draw.randint(0, 12))) for _ in range(1500)] + [None, "", " ", ".", ". ", " .", "!\n", "\u2028.\u2028"]
    rows = [(i, draw.choice(gaps) + t if t and i % 3 == 0 else t, draw.choice(["en", "de", "xx", None])) for i, t in enumerate(texts)]
    terms = [(lang, kind, term, other, 1.0) for lang in ("en", "") for kind, term, other in [("abbreviation", "dr", None), ("abbreviation", "a.b", None), ("abbreviation", "οδος", None), ("starter", "the", None), ("starter", "meyer", None), ("collocation", "##", "meyer"), ("collocation", "no", "##")]]
    docs, model = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), spark.createDataFrame(terms, "lang string, kind string, term string, other string, score double")
    want = {r["doc_id"]: r["sentences"] for r in B.sentences(docs, model, broadcast_terms=0).collect()}
    monkeypatch.setattr(B, "TEXTS", 200)
    found = {r["doc_id"]: r["sentences"] for r in B.sentences(docs, model).collect()}
    assert found == want and sum(map(len, want.values())) > 4000


def test_the_model_is_worked_out_once(spark, corpus):
    found = B.learn(corpus)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.count() > 0 and "Join" not in plan and "Exchange" not in plan
