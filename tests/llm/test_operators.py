"""Each operator against a plain loop, and on awkward input."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash
from conftest import SF_DIR
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from burnish.llm import bpe, decontaminate, exact_dedup, language, pages, pseudonyms, repeats, simhash, similar, suffixes, toxicity, urls
from burnish.llm.frames import smallest_reachable
from burnish.llm.queries import QUERIES, URL_RULES

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
CLASHING = "print long, sha string, label int, component_id long, digest string, key long, at long, path string, host string, n long, run long, row long"


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns named like the operators' own."""
    rows = [(1, "the quick brown fox " * 4000), (2, ""), (3, None), (None, "a b c d e"), (None, None), (4, "Same text"), (4, "Same text"), (5, "Sametext"), (6, "  \t\n "), (7, "é 漢 😀 <|endoftext|> 4417744280351547"), (8, "x" * 5000)]
    extra = [f"cast(null as {c.split()[1]}) as {c.split()[0]}" for c in CLASHING.split(", ")]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' as lang", *extra)


def operators(spark):
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    return {
        "repeats": lambda d: repeats.remove_repeats(d),
        "pseudonyms": lambda d: pseudonyms.pseudonymise(d, b"k"),
        "urls": lambda d: urls.filter_urls(d.withColumnRenamed("text", "url"), URL_RULES, key="doc_id"),
        "simhash": simhash.near_duplicates,
        "toxicity": lambda d: toxicity.score(d, toxicity.learn(d, labels)),
        "bpe": lambda d: bpe.decode(bpe.encode(d, VOCABULARY, spread=1000), VOCABULARY),
        "exact": exact_dedup.exact_duplicates,
        "language": lambda d: language.identify(d, language.learn_profiles(d)),
        "pages": lambda d: pages.extract(d.withColumnRenamed("text", "html").withColumn("url", F.lit("http://a.b/c")), key="doc_id"),
    }


@pytest.mark.parametrize("name", "repeats pseudonyms urls simhash toxicity bpe exact language pages".split())
def test_awkward_and_empty(spark, awkward, name):
    apply = operators(spark)[name]
    key = "page_id" if name in ("urls", "pages") else "doc_id"
    assert Counter(r[key] for r in apply(awkward).collect()) == Counter(r["doc_id"] for r in awkward.collect())
    assert apply(awkward.limit(0)).collect() == []


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_awkward_tables(spark, awkward, name):
    """Nulls, repeated rows, clashing names (the pipeline's own among them), and no rows at all."""
    step, odd = dict(corpus_pipeline.STAGES)[name], awkward.withColumn("_pipeline_row", F.lit("mine"))
    got = step(spark, odd, SF_DIR)
    if name == "bpe":
        assert Counter(r.doc_id for r in got.collect()) == Counter(r.doc_id for r in odd.collect())
    else:
        left = Counter(tuple(map(str, r)) for r in got.collect())
        assert got.columns == odd.columns and left and not left - Counter(tuple(map(str, r)) for r in odd.collect())
    assert step(spark, odd.limit(0), SF_DIR).collect() == []


def test_leaks_on_awkward_tables(spark, awkward):
    item = "the quick brown fox the quick brown"
    rows = [(1, item), (1, item), (None, item), (2, None), (3, "")]
    items = spark.createDataFrame(rows, "item_id long, text string").withColumns({"hash": F.lit("x"), "doc_id": F.lit(1), "at": F.lit(2)})
    got = decontaminate.leaks(awkward.unionByName(awkward.where("doc_id = 1")), items).collect()
    assert [(r.doc_id, r.item_id, r.n_found, r.n_windows) for r in got] == [(1, 1, 3, 3)]
    assert decontaminate.leaks(awkward.limit(0), items).collect() == decontaminate.leaks(awkward, items.limit(0)).collect() == []


def test_similar_texts_on_awkward_tables(spark, awkward):
    numbered = awkward.withColumn("own", F.monotonically_increasing_id())
    texts = {r.own: " ".join((r.text or "").lower().split()) for r in numbered.collect()}
    got = {r.doc_id: r.component_id for r in similar.similar_texts(numbered, "own").collect()}
    assert {i: got.get(i, i) for i in texts} == {i: min(j for j, t in texts.items() if t == own) for i, own in texts.items()}
    assert similar.similar_texts(numbered.limit(0), "own").collect() == []


def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


# -- repeats ------------------------------------------------------------------------------------


def test_suffix_order(monkeypatch):
    rng = random.Random(1)
    for _ in range(150):
        letters = rng.choice([b"ab", b"abc", bytes(range(256)), b"a"])
        text = np.array([rng.choice(letters) + 2 for _ in range(rng.randint(1, 60))] + [0], np.uint16)
        monkeypatch.setattr(suffixes, "HELD", rng.choice([3, 1 << 22]))
        got = np.concatenate(list(suffixes.suffix_order(text, 258)))[::-1].tolist()
        assert got == sorted(range(len(text)), key=lambda i: tuple(text[i:].tolist()))


@pytest.mark.parametrize("hot", [1, 50_000])
def test_repeats(spark, hot):
    rng = random.Random(2)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(70))
    texts = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 90))) for _ in range(40)]
    texts += [t[:20] + passage[: rng.randint(30, 70)] + t[20:] for t in texts] + ["ab" * 60, "é" * 40, texts[0], texts[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    length, raw = 40, [t.encode() for t in texts]
    seen = Counter(b[k : k + length] for b in raw for k in range(len(b) - length + 1))
    want = []
    for i, b in enumerate(raw):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        want.append((i, len(b), int(gone.sum()), bytes(c for c, g in zip(b, gone) if not g)))
    got = repeats.remove_repeats(df, length=length, hot=hot).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in got) == want


# -- pseudonyms ---------------------------------------------------------------------------------


def test_permutation_and_round_trip(spark):
    forth, back = pseudonyms.Permutation(b"k"), pseudonyms.Permutation(b"k", True)
    for size in (2, 3, 10, 97, 400):
        image = [forth("x", n, size) for n in range(size)]
        assert sorted(image) == list(range(size)) and [back("x", n, size) for n in image] == list(range(size))
    text = (
        "card 4417744280351547 or 4417-7442-8035-1547, not 4417744280351548; +1 (301) 555-0346, (301) 555-0346; 144.137.247.239, 999.1.1.1; "
        "2020-02-29, 3/4/1990, 04/23/1999, 2020-13-01; 123-45-6789; GB82 WEST 1234 5698 7654 32; und.34@mail7.example.com. Version 2.0."
    )
    df = spark.createDataFrame([(1, text), (2, "4417744280351547"), (3, None)], "doc_id long, text string")
    out = {r.doc_id: r for r in pseudonyms.pseudonymise(df, b"k").collect()}
    new = out[1].text
    cards = re.findall(r"(?:\d[ -]?){15}\d", new)
    assert cards[0] == cards[1].replace("-", "") == out[2].text != "4417744280351547"
    assert pseudonyms.luhn_digit(cards[0][:-1]) == cards[0][-1]
    assert len(new.split()) == len(text.split()) and out[1].kinds == {"card": 2, "phone": 2, "ip": 1, "date": 3, "ssn": 1, "iban": 1, "mail": 1}
    for kept in ("4417744280351548", "999.1.1.1", "2020-13-01", "Version 2.0.", "@mail7.example.com"):
        assert kept in new
    restored = pseudonyms.pseudonymise(pseudonyms.pseudonymise(df, b"k"), b"k", restore=True)
    assert {r.doc_id: r.text for r in restored.collect()} == {1: text, 2: "4417744280351547", 3: None}
    docs = documents(spark).select("doc_id", "text")
    assert pseudonyms.pseudonymise(pseudonyms.pseudonymise(docs, b"k"), b"k", restore=True).select("doc_id", "text").exceptAll(docs).isEmpty()


def test_values_stay_apart_in_every_format():
    """Equal numbers and days share a pseudonym whatever the spacing, different ones never do, and all are restored."""
    rng = random.Random(6)
    forth, back = pseudonyms.Permutation(b"k"), pseudonyms.Permutation(b"k", True)
    seen: dict[str, dict[str, str]] = defaultdict(dict)
    for _ in range(1500):
        country = rng.choice(["1", "7", "34", "44", "351", "971"])
        own = "".join(rng.choice("0123456789") for _ in range(9))
        day = rng.randrange(1, 29), rng.randrange(1, 13), rng.randrange(1900, 2100)
        for kind, value, found in (
            ("phone", country + own, f"+{country}{own}"),
            ("phone", country + own, f"+{country} {own[:3]} {own[3:6]} {own[6:]}"),
            ("local", own + "1", f"{own[:3]}-{own[3:6]}-{own[6:]}1"),
            ("local", own + "1", f"({own[:3]}) {own[3:6]}-{own[6:]}1"),
            ("day", str(day), f"{day[2]}-{day[1]:02d}-{day[0]:02d}"),
            ("day", str(day), f"{day[2]}/{day[1]:02d}/{day[0]:02d}"),
        ):
            text = f"see {found} there"
            new, counts = pseudonyms.replace(text, forth, {})
            assert sum(counts.values()) == 1 and pseudonyms.replace(new, back, {})[0] == text, found
            assert re.sub(r"\d", "0", new) == re.sub(r"\d", "0", text)
            seen[kind].setdefault(value, re.sub(r"\D", "", new))
            assert seen[kind][value] == re.sub(r"\D", "", new), found
    for values in seen.values():
        assert len(set(values.values())) == len(values)


def test_timestamps_and_long_keys():
    forth = pseudonyms.Permutation(b"k")
    text = "at 2024-01-05T10:00:00Z, 2024-01-05 and 2024/01/05 10:00"
    new, counts = pseudonyms.replace(text, forth, {})
    assert counts == {"date": 3} and new[13:] != text[13:] and new[13:].startswith("T10:00:00Z")
    assert pseudonyms.replace(new, pseudonyms.Permutation(b"k", True), {})[0] == text
    keys = [b"s" * 64 + end for end in (b"", b"a", b"b")]
    assert len({pseudonyms.Permutation(k)("x", 5, 10**9) for k in keys}) == 3


def test_pseudonyms_against_whole_permutations(spark):
    """Every value of the documents, found by plain patterns, stands where a permutation written out puts it."""
    docs = {r.doc_id: r.text for r in documents(spark).collect()}
    out = {r.doc_id: r for r in pseudonyms.pseudonymise(documents(spark), b"k").collect()}
    permute = pseudonyms.Permutation(b"k")
    for doc_id, text in docs.items():
        found = re.findall(r"(?<![\w.+@-])\d{1,3}(?:\.\d{1,3}){3}(?![\w@]|[.-]\d)", text)
        new = re.findall(r"(?<![\w.+@-])\d{1,3}(?:\.\d{1,3}){3}(?![\w@]|[.-]\d)", out[doc_id].text)
        for old, now in zip(found, new, strict=True):
            parts = [int(p) for p in old.split(".")]
            if all(p < 256 and str(p) == q for p, q in zip(parts, old.split("."))):
                number = permute("ip", sum(p << (8 * (3 - i)) for i, p in enumerate(parts)), 1 << 32)
                assert now == ".".join(str(number >> s & 255) for s in (24, 16, 8, 0))
            else:
                assert now == old
        assert re.sub(r"[0-9A-Za-z]+", "", text) == re.sub(r"[0-9A-Za-z]+", "", out[doc_id].text)
        assert re.findall(r"[^\W\d]{3,}", re.sub(r"\S*[\d@]\S*", "", text)) == re.findall(r"[^\W\d]{3,}", re.sub(r"\S*[\d@]\S*", "", out[doc_id].text))


# -- urls ---------------------------------------------------------------------------------------


def test_url_rules(spark):
    rows = [(None, None), (1, "x"), (2, "HTTP://A.Org/?x=1"), (3, "a://b.com/de/x?y#z"), (4, "a://notorg/"), (5, "a://ÄB.com/fr/://"), (6, "a://x.example.org/en/12"), (7, "a://x.example.org/es/1")]
    got = {r.page_id: r for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), URL_RULES).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in (None, 1, 2, 3, 4, 5, 6, 7)] == [
        ("", "", None), ("", "", None), ("a.org", "/", "org/"), ("b.com", "/de/x", "com/de/"), ("notorg", "/", None),
        ("Äb.com", "/fr/://", "com/fr/"), ("x.example.org", "/en/12", "example.org/en/1"), ("x.example.org", "/es/1", "example.org/es/"),
    ]
    assert [got[i].verdict for i in (2, 3, 5, 6, 7)] == ["allow", "block", "allow", "block", "block"]


def test_url_trees_learn(spark):
    rng = random.Random(3)
    bad = [f"http://{rng.randint(1000, 9999)}-free-{rng.randint(0, 99)}.biz/a/{rng.random()}?a=1&b=2" for _ in range(200)]
    good = [f"http://news{i % 7}.org/world/story{i}" for i in range(200)]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(bad + good)], "page_id long, url string")
    rules = [urls.Rule("block", "biz/a"), urls.Rule("allow", "org/world/story1")]
    got = urls.filter_urls(df, rules).where("rule is null").collect()
    assert got and all(r.verdict == "allow" for r in got)


# -- near duplicates ----------------------------------------------------------------------------


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, awkward):
    df = documents(spark).select("doc_id", "text").union(awkward.select(F.col("doc_id") + 1000, "text"))
    rows = df.collect()
    prints = {r.doc_id: fingerprint(r.text) for r in rows if r.doc_id is not None}
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    for r in simhash.near_duplicates(df).where("doc_id is not null").collect():
        assert (r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", find(r.doc_id))


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 130)] + [(5, 5)]
    got = {r.node: r.root for r in smallest_reachable(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 130)}


def test_close_pairs(spark):
    rng = random.Random(4)
    prints = [rng.getrandbits(64) for _ in range(20)]
    prints += [p ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for p in prints for _ in range(4)]
    signed = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    got = simhash.close_pairs(spark.createDataFrame([(p,) for p in signed], "print long")).collect()
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want)


# -- classifiers --------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    df = QUERIES["op5_toxicity"](spark, SF_DIR.replace("0.001", "0.01")).where("held_out")
    labels = spark.read.parquet(f"{SF_DIR.replace('0.001', '0.01')}/labels.parquet")
    rows = df.join(labels, "doc_id").collect()
    toxic, clean = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    assert np.mean([(t > c) + 0.5 * (t == c) for t in toxic for c in clean]) > 0.8
    assert np.mean([c >= 0.5 for c in clean]) < 0.05


def test_toxicity_net_is_whole_text():
    rng = random.Random(5)
    plain = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(50)]
    texts = [[rng.choice(plain) for _ in range(40)] for _ in range(200)]
    labels = [i % 2 for i in range(200)]
    for words, label in zip(texts, labels):
        if label:
            words[rng.randrange(40)] = "vile"
    net = toxicity.train(texts, labels)
    toxicity.calibrate(net, np.array([toxicity.Scorer(net).logit(t) for t in texts]), np.array(labels), [""] * 200, np.ones(200))
    scorer = toxicity.Scorer(net)
    clean = " ".join(rng.choice(plain) for _ in range(100_000))
    assert scorer.score(clean) < 0.5 < scorer.score(clean + " vile") and scorer.score("vile") > 0.5


def test_toxicity_by_a_plain_forward_pass(spark):
    """Every document's logit by loops over windows and filters."""
    docs = documents(spark)
    net = toxicity.learn(docs, spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    got = {r.doc_id: r for r in toxicity.rate(docs, net).collect()}
    for r in docs.collect():
        words = toxicity.words_of(r.text)
        vectors = [net.vectors[list(net.lines(w))].sum(0) for w in words] + [np.zeros(net.vectors.shape[1])] * max(toxicity.WIDTHS)
        best = []
        for filters in net.filters:
            width = len(filters)
            answers = [sum(vectors[at + j] @ filters[j] for j in range(width)) for at in range(len(vectors) - width + 1)]
            best.append(np.max(answers, axis=0))
        logit = np.maximum(np.concatenate(best) + net.bias, 0) @ net.weights + net.intercept[0]
        assert got[r.doc_id].logit == pytest.approx(float(logit), abs=1e-3) and got[r.doc_id].language == toxicity.told_language(words)


def test_language_held_out(spark):
    rows = QUERIES["op9_language_id"](spark, SF_DIR).where("held_out").join(documents(spark).select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_by_plain_distances(spark):
    """The language of every document by counted n-grams and a loop over ranks."""
    docs = documents(spark)
    learnt = language.learn_profiles(docs)
    profiles = defaultdict(dict)
    for r in learnt.collect():
        profiles[r.lang][language.spelled(r.code)] = r["rank"]
    worst = max(rank for own in profiles.values() for rank in own.values()) + 1
    got = {r.doc_id: r for r in language.identify(docs, learnt).collect()}
    for r in docs.collect():
        words = re.sub(r"[\W\d_]+", " ", r.text.lower()).split()
        counts = Counter(g for w in words for n in (1, 2, 3) for i in range(len(w) + 3 - n) if (g := f" {w} "[i : i + n]) != " " and (n < 3 or g[1] != " "))
        if not words:
            assert got[r.doc_id].lang_pred == "und"
            continue
        # Two words meet in one space, so n-grams of two characters that start a word also end the last one.
        code = lambda g: sum(ord(c) << (21 * i) for i, c in enumerate(reversed(g)))
        top = sorted(counts, key=lambda g: (-counts[g], code(g)))[:worst]
        out = {name: sum(abs(own[g] - i) if g in own else worst for i, g in enumerate(top)) / len(top) for name, own in profiles.items()}
        best = min(sorted(out), key=out.get)
        assert got[r.doc_id].lang_pred == best and got[r.doc_id].score == pytest.approx(1 - out[best] / worst)


def test_grams_in_parts(monkeypatch):
    text = "Ünder the 12 bridges, under-the bridge"
    whole = dict(zip(*map(list, language.grams(text))))
    words = " " + " ".join(re.findall(r"[^\W\d_]+", text.lower())) + " "
    want = Counter(words[i : i + n] for n in (1, 2, 3) for i in range(len(words) - n + 1) if words[i : i + n] != " " and " " not in words[i + 1 : i + n - 1])
    assert {language.spelled(int(c)): int(n) for c, n in whole.items()} == want
    monkeypatch.setattr(language, "PART", 5)
    assert dict(zip(*map(list, language.grams(text)))) == whole


# -- bpe ----------------------------------------------------------------------------------------


def test_bpe_words():
    theirs, ours = Tokenizer.from_file(VOCABULARY), bpe.Encoder(bpe.Vocabulary(VOCABULARY))
    rng = random.Random(6)
    parts = ["a", "e", "th", "in", "the", "é", "漢", "😀", "'s", "1", "!!", "$", " ", "\n", "Σ", "İ", "ß", "<|endoftext|>", "\x1c", "\u00a0", "e\u0301"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(600)]
    texts += ["".join(rng.choice(k) for _ in range(rng.randint(40, 900))) for k in ["a", "ab", "thein", "é漢", "!?", "etaoinshrdlu"] for _ in range(60)]
    for t in texts:
        assert np.frombuffer(ours.text(t), "<u4").tolist() == theirs.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("spread", [1 << 20, 300])
def test_bpe_frames(spark, awkward, spread):
    theirs = Tokenizer.from_file(VOCABULARY)
    df = documents(spark).select("doc_id", "text").union(awkward.select("doc_id", "text"))
    want = Counter()
    for r in df.collect():
        ids = theirs.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id, np.array(ids, "<u4").tobytes(), theirs.decode(ids, skip_special_tokens=False)] += 1
    got = bpe.decode(bpe.encode(df, VOCABULARY, spread=spread), VOCABULARY).collect()
    assert Counter((r.doc_id, bytes(r.ids), r.decoded) for r in got) == want
    assert all(r.n_tokens == len(r.ids) // 4 for r in got)


# -- decontamination ----------------------------------------------------------------------------


def test_templates(spark):
    docs = [
        (1, "Yes. anna said that Bob had 12 apples and gave 3 kg to Bob on friday evening when it rained hard"),
        (2, "Well, then Paul had 15 apples and gave 4 kg to Paul on friday evening when it rained hard"),
        (3, "Well, then Paul had 15 apples and gave 4 kg to Mark on friday evening when it rained hard"),
        (4, "THEN BOB HAD 12 APPLES AND GAVE 3 KG TO BOB ON FRIDAY EVENING WHEN IT RAINED HARD!"),
        (None, None),
        (5, ""),
    ]
    items = spark.createDataFrame([(7, "then Bob had 12 apples and gave 3 kg to Bob on friday evening when it rained hard"), (None, "x"), (8, None)], "item_id long, text string")
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()
    assert {(r.doc_id, r.item_id, r.new_parameters) for r in got} == {(1, 7, False), (2, 7, True), (4, 7, False)}
    assert decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string").limit(0), items).collect() == []
    assert decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), items.limit(0)).collect() == []


def test_templates_openers_and_dense(spark):
    """Names that open sentences change, and windows of mostly slots are compared where others align."""
    items = [(1, "Anna has 12 apples. Tom gives her 5 more apples. How many apples does Anna have now?"), (2, "then he read the list to Ann 3 Bob 4 Cid 5 Dan 6 and slept on")]
    docs = [
        (1, "Mary has 15 apples. Paul gives her 7 more apples. How many apples does Mary have now?"),
        (2, "Mary has 15 apples. Paul gives her 7 more apples. How many apples does Jane have now?"),
        (3, "then he read the list to Eve 8 Fay 9 Gus 7 Hal 2 and slept on"),
        (4, "then he read the list to Eve 8 Eve 9 Eve 7 Eve 2 and slept on"),
        (5, "Eve 8 Fay 9 Gus 7 Hal 2"),
        (6, "then he read the list to Eve 8 Fay 9 but Gus 7 Hal 2 and slept on"),
        (None, "then he read the list to Eve 8 Fay 9 Gus 7 Hal 2 and slept on"),
    ]
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.n_windows, r.n_found, r.new_parameters) for r in got if r.doc_id not in (2, 4)} == {(1, 1, 13, 13, True), (3, 2, 13, 13, True), (None, 2, 13, 13, True)}
    assert not any(r.doc_id == 2 for r in got)


def test_leaks_by_words(spark):
    sf = SF_DIR.replace("0.001", "0.01")
    words = lambda t: re.findall(r"\d+(?:[.,]\d+)*|[^\W\d_]+", t.lower())
    at, size, want = defaultdict(set), {}, set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = words(r.text)
        size[r.item_id] = len(w) - 4
        for k in range(len(w) - 4):
            at[tuple(w[k : k + 5])].add((r.item_id, k))
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        w, found = words(r.text), defaultdict(set)
        for k in range(len(w) - 4):
            for item, place in at.get(tuple(w[k : k + 5]), ()):
                found[item].add(place)
        want |= {(r.doc_id, i) for i, places in found.items() if len(places) >= 0.8 * size[i]}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op7_decontamination"](spark, sf).collect() if not r.new_parameters}
    assert want and got == want


# -- exact duplicates ---------------------------------------------------------------------------


def test_golomb():
    rng = np.random.default_rng(7)
    for n in (1, 2, 100, 5000):
        values = np.unique(rng.integers(0, 1 << 60, n, np.uint64))
        low, quotients, remainders = exact_dedup.golomb_encode(values)
        assert (exact_dedup.golomb_decode(len(values), low, quotients, remainders) == values).all()
    low, quotients, remainders = exact_dedup.golomb_encode(np.arange(0, 5000, dtype=np.uint64))
    assert len(quotients) + len(remainders) < 2000


def test_exact_ties(spark, awkward):
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(awkward).collect())
    assert got[4, 4, 3, True] == 1 and got[4, 4, 3, False] == 1 and got[5, 4, 3, False] == 1
    assert got[6, 6, 4, True] == got[2, 6, 4, False] == got[3, 6, 4, False] == got[None, 6, 4, False] == 1
    groups = {r.doc_id: r.group_size for r in exact_dedup.exact_duplicates(awkward).collect()}
    assert groups[2] == groups[3] == groups[6] == 4


# -- pages --------------------------------------------------------------------------------------


def test_page_text():
    source = """<html><head><title>T</title></head><body class="home no-sidebar"><header><h1>Site</h1></header><div class="cookie-banner">We use</div>
      <nav><ul><li><a href=x>A</a><li><a>B</a></ul></nav><div id="content"><h1>Title &amp; more</h1><p>Hello   <b>bold</b>text &copy; 5 &lt; 6 with words to fill
      <p>Second<br>line <a href="x">link</a> goes on<ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table><div class=comments><p>Nice!</div>
      <form>Name <input></form></div><aside>Side</aside><footer>&copy;</footer><!-- c --><script>if(a<b){"</p>"}</script></body>"""
    want = ["Title & more", "Hello boldtext © 5 < 6 with words to fill", "Second line link goes on", "one", "two", "c1", "c2"]
    assert pages.parse(source).text(None).split("\n\n") == want
    assert pages.parse("").text(None) == "" and pages.parse("just < text").text(None) == "just < text"


@pytest.mark.parametrize("tag", "video audio select object svg button canvas noscript template".split())
def test_unclosed_elements_hold_nothing(tag):
    page = f"<body><p>First…</p><{tag} src=x><p>Second…</p><div>Third <{tag} a='>'>left out</{tag}> part</div>"
    assert pages.parse(page).text(None).split("\n\n") == ["First…", "Second…", "Third part"]


def test_article_text_is_kept():
    kept = [
        "Let <math><mi>x</mi></math> be one",
        *(f"<{t}>text of {i}</{e}>" for i, (t, e) in enumerate([("div class='share-price'", "div"), ("p class='notice-board'", "p"), ("section id=social-history", "section")])),
        "<table class='data-widget'><tr><td>cell</table>",
    ]
    gone = [f"<div class='{c}'>gone</div>" for c in ("ad", "cookie-banner", "top-nav-bar", "site-footer", "comments", "related-posts", "sidebar2", "share")]
    page = "<article><p>An opening of some length to begin with.</p>" + "".join(f"<div>{k}</div>" for k in kept) + "".join(gone) + "</article>"
    want = ["An opening of some length to begin with.", "Let x be one", "text of 0", "text of 1", "text of 2", "cell"]
    assert pages.parse(page).text(None).split("\n\n") == want


def test_long_paths_stay_apart():
    deep = "<div class=a>" * 600
    first, second = (pages.parse(f"<div class={c}>{deep}<p>text").containers[-1].path for c in "xy")
    assert first != second and len(first) < 2200


def test_pages_by_pattern(spark):
    import html

    rows = pages.extract(spark.read.parquet(f"{SF_DIR}/pages.parquet")).join(spark.read.parquet(f"{SF_DIR}/pages.parquet").select("page_id", "html"), "page_id").collect()
    for r in rows:
        article = re.search(r"<article>(.*?)(?:</article>|<footer>|\Z)", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_hosts_vote(spark):
    page = '<body><div class="story">{}</div><div class="box">{}</div></body>'
    texts = [("long text " * 9, "short")] * 3 + [("brief", "a much longer box text " * 9)]
    df = spark.createDataFrame([(i, "http://h.org/x", page.format(*t)) for i, t in enumerate(texts)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in pages.extract(df).collect()}[3] == "brief"


# -- pipeline -----------------------------------------------------------------------------------


def test_pipeline(spark):
    docs, columns = documents(spark), documents(spark).columns
    net = toxicity.learn(docs, spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    left = {r.doc_id: r.text for r in docs.collect()}
    for r in toxicity.score(docs, net).where("predicted = 1").collect():
        del left[r.doc_id]
    firsts = {}
    for i in sorted(left, key=lambda i: (-len(left[i]), i)):
        firsts.setdefault(re.sub(r"[\x20\x09-\x0D]", "", left[i]), i)
    left = {i: left[i] for i in firsts.values()}
    root = jaccard_roots(left)
    left = {i: t for i, t in left.items() if root[i] == i}
    frame = docs.where(F.col("doc_id").isin(list(left)))
    for r in decontaminate.leaks(frame, spark.read.parquet(f"{SF_DIR}/benchmark.parquet")).collect():
        left.pop(r.doc_id, None)
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF_DIR).collect()} == set(left)
    for _, step in corpus_pipeline.STAGES[:-1]:
        assert step(spark, docs, SF_DIR).columns == columns


def five_word_sets(texts):
    words = {i: (t or "").encode().lower().split() for i, t in texts.items()}
    return {i: frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for i, w in words.items()}


def jaccard_roots(texts):
    """Smallest id that pairs with a five-word Jaccard similarity of 0.8 or more lead to, by brute force."""
    sets = five_word_sets(texts)
    root, at, common = {i: i for i in sets}, defaultdict(list), Counter()
    for i, own in sets.items():
        for s in own:
            common.update((j, i) for j in at[s])
            at[s].append(i)
    links = [p for p, n in common.items() if n >= 0.8 * (len(sets[p[0]]) + len(sets[p[1]]) - n) - 1e-9]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    return root


def test_pipeline_near_copies(spark):
    """All pairs of sf0.01, documents 1 and 255 among them, and chains, hot groups, short and empty texts."""
    docs = spark.read.parquet(f"{SF_DIR.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text")
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base, chain, texts = [word() for _ in range(60)], [word() for _ in range(60)], ["", "A b", "a  B", "c d", "\n"]
    for _ in range(40):
        own = base[:]
        own[rng.choice([0, 1, 58, 59, 30])] = word()
        texts.append(" ".join(own))
        chain = chain[rng.randint(1, 5) :] + [word()]
        texts.append(" ".join(chain + [word() for _ in range(60 - len(chain))]))
    df = docs.union(spark.createDataFrame([(100_000 + i, t) for i, t in enumerate(texts)], docs.schema)).repartition(5)
    root = jaccard_roots({r.doc_id: r.text for r in df.collect()})
    want = {i for i, r in root.items() if i == r}
    assert root[255] == root[1] and root[100_002] == 100_001
    got = [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, df, SF_DIR).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_near_copies_are_proposed_by_simhash(spark, monkeypatch):
    """Of SimHash's groups only similar texts are linked, and they are not compared again; what it misses is found."""
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), " ".join([*words[:-1], "z"]), "other words that stand alone", " ".join(["y", *words[1:]])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    group, asked, verified = {0: 0, 1: 0, 2: 0, 3: 3}, [], similar._verified
    proposed = F.coalesce(F.create_map(*[F.lit(x) for p in group.items() for x in p])[F.col("doc_id")], F.col("doc_id"))
    monkeypatch.setattr(similar.simhash, "near_duplicates", lambda rows, *_: rows.select("doc_id", proposed.cast("long").alias("component_id")))
    monkeypatch.setattr(similar, "_verified", lambda pairs, *args: asked.append(sorted(map(tuple, pairs.collect()))) or verified(pairs, *args))
    got = {r.doc_id: r.component_id for r in similar.similar_texts(df).collect()}
    assert got == {0: 0, 1: 0, 3: 0}
    assert asked[0] == [(0, 1), (0, 2)] and asked[1] == [(0, 3)]


def test_sets_of_shingles_stay_in_a_task(spark, monkeypatch):
    """One Python worker a task makes sets and reads them, few rows at a time; what it hands on is the same."""
    plans, stage = {}, similar.stage
    monkeypatch.setattr(similar, "stage", lambda df, label: plans.setdefault(label, df._jdf.queryExecution().optimizedPlan().toString()) and stage(df, label))
    texts = [f"w{i} a b c d e f g h i j k l m n o p q r s t u v" if i % 2 else None for i in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.component_id for r in similar.similar_texts(df).collect()}
    assert got == {i: i % 2 for i in range(600)}
    assert plans["entries"].count("MapInArrow") == 1
    batch = pa.record_batch([pa.array(range(600)), pa.array([(t or "").encode() for t in texts])], ["doc_id", "body"])
    parts = list(similar._sets(iter([batch, batch.slice(0, 0)]), 5))
    assert [x for ids, _ in parts for x in ids.to_pylist()] == list(range(600)) and max(len(sets) for _, sets in parts) <= similar.SLICE < 600
    assert [s.tolist() for _, sets in parts for s in sets] == [r.hashes for r in similar.shingle_sets(df, "doc_id", "text").orderBy("doc_id").collect()]


def test_pipeline_writes_no_copy_of_texts(spark, tmp_path, monkeypatch):
    """Rows of whole files are told by their places; parts of files, and rows that repeat, are written before they are numbered."""
    written, stage = [], corpus_pipeline.stage
    monkeypatch.setattr(corpus_pipeline, "stage", lambda df, label: written.append((label, df.columns)) or stage(df, label))
    texts = ["some words that stand alone", "some words  that stand alone", None, "", "other words that stand alone", "x"] * 20
    df = spark.createDataFrame([(i if i % 7 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    df.repartition(3).write.parquet(path := str(tmp_path / "docs a%b"))
    files = spark.read.parquet(path)
    got = corpus_pipeline.drop_copies(spark, files, SF_DIR)
    assert sorted(r.text or "" for r in got.collect()) == ["", "other words that stand alone", "some words  that stand alone", "x"]
    assert written and not any("text" in columns for _, columns in written)
    rows, row = corpus_pipeline._numbered(files)
    assert rows.select(row).distinct().count() == files.count() == rows.count()
    gone = rows.where("doc_id % 2 = 0")
    kept = corpus_pipeline._without(rows, row, gone.union(gone), files)
    assert sorted(map(str, kept.collect())) == sorted(map(str, files.where("doc_id is null or doc_id % 2 <> 0").collect()))
    for part in (files.where("doc_id > 5"), files.limit(3), files.union(files), files.join(spark.range(2)), df, df.limit(0)):
        assert corpus_pipeline._placed(part, "row") is None


def test_toxicity_thresholds_use_all_labels(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, f"{'der die das und' if i % 4 == 0 else 'the of and to'} {'vile' if i % 3 == 0 else 'mild'} {rng.random()} w{i}") for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(600)], "doc_id long, toxic int")
    seen, plain = [], toxicity.calibrate

    def spy(net, logits, labels, languages, weights, least=20, times=None):
        times = np.ones(len(logits), int) if times is None else times
        seen.append(Counter())
        for n, label, name in zip(times, labels, languages):
            seen[-1][name, int(label)] += int(n)
        plain(net, logits, labels, languages, weights, least, times)

    monkeypatch.setattr(toxicity, "calibrate", spy)
    toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string"), labels, learn_rows=50)
    trained = sum(i % 5 < 4 for i in range(100))
    assert seen[-1].total() == 600 - trained and min(seen[-1]["de", v] for v in (0, 1)) >= 20
    net = toxicity.train([["a"]], [1], 0)
    toxicity.calibrate(net, np.array([-1.0, 1, 3]), np.array([0, 0, 1]), ["de"] * 3, np.ones(3), times=np.array([1000, 30, 25]))
    toxicity.calibrate(net, np.array([-1.0, 1, 1]), np.array([0, 0, 1]), ["de"] * 3, np.ones(3), times=np.array([1000, 30, 25]))
    assert net.thresholds["de"] > 1


def test_pipeline_tells_rows_apart(spark, monkeypatch):
    """Null and repeated doc_ids: every row is judged by its own text, and a group keeps one row."""
    flag = (F.instr("text", "vile") > 0).cast("int").alias("predicted")
    monkeypatch.setattr(toxicity, "learn_and_score", lambda df, labels, keep: df.select("doc_id", *keep, flag))
    item = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").where("length(text) > 80").first().text
    long = " ".join(f"w{i}" for i in range(60))
    cases = [
        (corpus_pipeline.reject_toxic, [(None, "vile"), (1, "vile"), (1, "b"), (None, "b")], [(None, "b"), (1, "b")]),
        (corpus_pipeline.drop_copies, [(1, "a b"), (1, "a b"), (None, "x"), (None, "x"), (2, "z"), (2, "zz"), (3, "z"), (1, "q"), (None, "q")], [(None, "x"), (1, "a b"), (1, "q"), (2, "z"), (2, "zz")]),
        (corpus_pipeline.drop_near_copies, [(None, long), (None, long), (4, long + " x"), (4, "other text"), (4, long + " y")], [(4, "other text"), (4, long)]),
        (corpus_pipeline.drop_leaks, [(None, item), (7, item), (7, "b")], [(7, "b")]),
    ]
    for step, rows, want in cases:
        got = [(r.doc_id, r.text) for r in step(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF_DIR).collect()]
        got = [(i, long if t.startswith(long) else t) for i, t in got]
        assert sorted(got, key=str) == sorted(want, key=str), step.__name__


def test_url_shares_use_all_labels(spark):
    """Suffixes outside the trees' sample have the rate of their own labelled URLs."""
    rows = [(f"http://a.s{i % 60}.org/{i}", "block" if i % 60 < 20 else "allow") for i in range(600)]
    host, path = urls.host_and_path(F.col("url"))
    labelled = spark.createDataFrame(rows + rows[:9], "url string, ruled string").withColumns({"host": host, "path": path})
    model = urls.learn(labelled, learn_rows=30)
    got = {r.suffix_2: r.f_suffix_2 for r in model.shares["suffix_2"].collect()}
    assert model.trees is not None and got == pytest.approx({f"s{i}.org": (10 * (i < 20) + 5 / 3) / 15 for i in range(60)})


def test_pipeline_decodes(spark):
    import hashlib

    theirs = Tokenizer.from_file(VOCABULARY)
    text = "Some words, é 漢"
    (row,) = corpus_pipeline.tokenise(spark, spark.createDataFrame([(1, text)], "doc_id long, text string"), SF_DIR).collect()
    assert np.frombuffer(row.ids, "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids
    assert row.decoded_sha256 == hashlib.sha256(theirs.decode(theirs.encode(text, add_special_tokens=False).ids, skip_special_tokens=False).encode()).hexdigest()
