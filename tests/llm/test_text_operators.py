"""Language, leaks, tokens, personal data, toxicity, resampling, id files and main text."""

import hashlib
import html as entities
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from duepath.llm import bpe, html, langid, leaks, pfor, pii, queries, resample, toxicity
from duepath.llm import text as tx
from duepath.llm.rows import few_of_each

BPE = (P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "no id"), (4, "same"), (4, "same"), (5, "ünï çødé 漢字 🙂 '' don't 12's"), (6, "x" * 9000), (7, "a  b \n\n c   \n" * 700), (8, "   wide  " * 300)]


def test_language_held_out(spark, sf):
    found = queries.QUERIES["op4_compression"](spark, sf).join(queries.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").where("lang is not null").collect()
    out = [r for r in found if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.9


def test_language_awkward_rows(documents):
    docs = documents([(k, f"der und die das nicht {k}" if k % 2 else f"the and of that with {k}", "de" if k % 2 else "en") for k in range(40)] + [(50, None, "en"), (51, "12 !?", "en"), (52, "und das nicht die", None), (None, "the that", None)], "score")
    model = langid.train(docs)
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert got[50].lang_pred == got[51].lang_pred == "und" and got[50].score == 0 and got[51].rejected
    assert got[52].lang_pred == "de" and 0 <= got[52].score <= 1
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id in (50, 51)").count() == 0 and kept.where("doc_id = 52").count() == 1
    assert {r.lang_pred for r in langid.predict(docs, langid.train(documents([]))).collect()} == {"und"}


def test_language_margin_is_relative_at_every_length(spark, documents):
    rng = random.Random(5)
    words = {"de": "der und die das nicht ist ein haus wald strasse morgen abend kinder schule", "en": "the and of that with house forest street morning evening children school", "fr": "le la les dans une maison foret rue matin soir enfants ecole"}
    rows = [(k, " ".join(rng.choice(words[lang].split()) for _ in range(80)), lang) for k, lang in enumerate(sorted(words) * 60)]
    model = langid.train(documents(rows))
    made = {lang: " ".join(rng.choice(w.split()) for _ in range(600)) for lang, w in words.items()}
    made["polish"] = " ".join(rng.choice("wszystkie dzieci ida szkoly gdzie ucza czytac pisac potem wracaja domu odrobic lekcje".split()) for _ in range(800))
    made["junk"] = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 10))) for _ in range(800))
    found = {name: model.classify(text) for name, text in made.items()}
    for lang in words:
        assert found[lang][0] == lang and found[lang][1] >= langid.MIN_SCORE
    assert found["polish"][1] < langid.MIN_SCORE and found["junk"][1] < langid.MIN_SCORE


def best_edits(item, words):
    row = [0] * (len(words) + 1)
    for k, w in enumerate(item):
        now = [k + 1]
        for j, x in enumerate(words):
            now.append(min(row[j] + (w != x), row[j + 1] + 1, now[j] + 1))
        row = now
    return min(row)


def tokens(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_leaks_against_brute_force(spark, documents):
    rng = random.Random(11)
    vocabulary = [f"v{k}" for k in range(60)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 4, 6, 9, 15, 25, 40, 70])))) for k in range(24)] + [(90, None), (91, ""), (None, "an item without any number at all in it")]
    rows = list(ODD)
    for k in range(80):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 120))]
        item = tokens(items[rng.randrange(24)][1])
        for _ in range(rng.randrange(0, max(1, len(item) // 8) + 1)):
            item[rng.randrange(len(item))] = "edit"
        at = rng.randrange(len(words) + 1)
        rows.append((100 + k, ", ".join(words[:at] + item + words[at:]).upper()))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in leaks.leaks(documents(rows, "edits"), bench, block_bytes=2000).collect()}
    want = {}
    for doc_id, text in rows:
        for item_id, item in items:
            words = tokens(item)
            edits = best_edits(words, tokens(text)) if words else 1
            if words and edits <= int(leaks.MAX_EDITS * len(words)):
                want[doc_id, item_id] = edits
    assert set(got) <= set(want) and all(want[k] <= e <= want[k] + 0 for k, e in got.items())
    close = {k for k, e in want.items() if e <= 0.1 * len(tokens(dict(items)[k[1]]))}
    assert close <= set(got) and len(got) >= 0.95 * len(want)
    clean = leaks.keep_clean(documents(rows, "edits"), bench)
    assert sorted((r.doc_id for r in clean.collect()), key=repr) == sorted((d for d, _ in rows if d not in {k[0] for k in got}), key=repr)
    assert leaks.leaks(documents([]), bench).count() == 0 and leaks.leaks(documents(rows), bench.limit(0)).count() == 0


@pytest.mark.parametrize("chunk,overlap", [(64, 16), (700, 100), (32_768, 1_024)])
def test_bpe_round_trip(documents, chunk, overlap):
    rng = random.Random(chunk)
    rows = ODD + [(100 + k, "".join(rng.choice(["word", "Ünï", " ", "  ", "\n", "'ll", "12", "!?", "aa"]) for _ in range(rng.randrange(400)))) for k in range(20)]
    got = bpe.digests(documents(rows, "row"), *BPE, chunk, overlap).collect()
    enc = bpe.encoding(*BPE)
    want = []
    for doc_id, text in rows:
        ids = enc.encode_ordinary(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)
    assert bpe.digests(documents([]), *BPE).count() == 0


def plain_spans(text):
    out = []
    for k, pattern in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
            if k == 1 and any(int(p) > 255 for p in m[0].split(".")) or k == 2 and (not 12 <= len(digits) <= 19 or total % 10) or k == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_personal_data(documents):
    rng = random.Random(2)
    signs = ["a", "@", ".", "1", "4", "+", " ", "-", "(", ")", "é", "4111 1111 1111 1111", "\n", "x.y", "10.0.0.1", "+49 30 1234567"]
    rows = ODD + [(100 + k, "".join(rng.choice(signs) for _ in range(60))) for k in range(300)] + [(900, "1" * 30_000 + "@" * 3000 + "+" * 3000), (901, "write to anna.berg (at) mail.example.com or call 555 123 4567 after lunch")]
    got = {(r.doc_id, r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone): r for r in pii.find(documents(rows, "spans")).collect()}
    for doc_id, text in rows:
        spans = plain_spans(text or "")
        key = (doc_id, hashlib.sha256(pii.written(spans).encode()).hexdigest(), *[sum(s[1] == k for s in spans) for k in range(4)])
        assert key in got
        assert set(filter(None, pii.written(spans).split(","))) <= set(got[key].spans.split(","))
    added = next(r for r in got.values() if r.doc_id == 901)
    assert "crf_email" in added.spans and "crf_phone" in added.spans and added.n_email == 0
    field = pii.production_field()
    for words, labels in map(pii.parse, pii.LABELLED):
        assert field.decode([words])[0].tolist() == labels
    assert pii.find(documents([])).count() == 0


def marked(line):
    """A labelled line as text, and its marked spans."""
    text, spans, at = "", [], 0
    for m in [*pii._MARK.finditer(line), None]:
        text += line[at : m.start() if m else len(line)]
        if m:
            spans.append((len(text), pii.BASE_KINDS.index(m[1]) + 4, len(text) + len(m[2])))
            text, at = text + m[2], m.end()
    return text, spans


def test_labelled_lines_are_found_whole(documents):
    more = ["please write to {email:Anna.Berg (AT) example (DOT) org} before noon", "{email:a [at] b [dot] c [dot] com}", "they met at the dot at noon", "anna.berg said so"]
    lines = [marked(line) for line in pii.LABELLED + more]
    got = {r.doc_id: r.spans for r in pii.find(documents([(k, text) for k, (text, _) in enumerate(lines)])).collect()}
    for k, (text, spans) in enumerate(lines):
        base = pii.base_spans(text)
        assert got[k] == pii.written(base + [x for x in spans if not any(s < x[2] and x[0] < e for s, _, e in base)]), text


UNSEEN = """{email:tom dot smith at acme dot co dot uk}
{email:maria at bigfirm dot com} about
{email:bob AT corp DOT net}
my mail is {email:sue dot ann at house dot org} thanks
reach {email:peter (at) green-energy (dot) eu} now
{email:hans.meier [at] beispiel.de} bitte
write {email:ada at lovelace dot example dot com}, please
{email:lisa at web dot de}
we were at school on the dot that day
she stood at the window and saw a dot far away
nobody at home knows dot matrix printers
look at this dot""".splitlines()


def test_written_addresses_outside_the_table(documents):
    table = {text for text, _ in map(marked, pii.LABELLED)}
    lines = [marked(line) for line in UNSEEN]
    assert not table & {text for text, _ in lines}
    got = {r.doc_id: (r.spans, r.n_added) for r in pii.find(documents([(k, f"first line\n{text}\nlast line") for k, (text, _) in enumerate(lines)])).collect()}
    for k, (text, spans) in enumerate(lines):
        assert got[k] == (pii.written([(a + 11, kind, b + 11) for a, kind, b in spans]), len(spans)), text


def test_viterbi_is_the_best_labelling():
    field = pii.fit(pii.LABELLED, rounds=5)
    words = "call 555 12".split()
    emit = field.scores(words)
    every = {(a, b, c): emit[0, a] + field.pair[a, b] + emit[1, b] + field.pair[b, c] + emit[2, c] for a in range(5) for b in range(5) for c in range(5)}
    assert tuple(field.decode([words])[0]) == max(every, key=every.get)


def test_toxicity_held_out_and_misspelt(spark, documents):
    rng = random.Random(4)
    words = ["river", "stone", "green", "window", "paper", "walking", "seven", "garden", "quiet", "silver"]
    rows, marks = [], []
    for k in range(600):
        text = [rng.choice(words) for _ in range(rng.randrange(20, 200))]
        if k % 3 == 0:
            text[rng.randrange(len(text))] = rng.choice(["idiotic", "idiots", "stupidly", "stupids"])
        rows.append((k, " ".join(text)))
        marks.append((k, k % 2, int(k % 3 == 0)))
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    docs = documents(rows + [(900, None), (901, ""), (902, "!!"), (903, "river stone what an idiiots green window paper walking"), (904, "river stone green window " * 5000), (None, "paper")], "predicted")
    model = toxicity.train(docs, labels, queries.crc_rest(3) != 1)
    got = {r.doc_id: r for r in toxicity.predict(docs, model).collect()}
    held = [k for k in range(600) if zlib.crc32(str(k).encode()) % 3 == 1]
    assert sum(got[k].predicted == (k % 3 == 0) for k in held) / len(held) > 0.95
    assert got[903].score > got[904].score and all(got[k].predicted == 0 for k in (900, 901, 902, 904))
    assert all(r.score == 0 or r.score < 1e-9 for r in toxicity.predict(docs, toxicity.fit([], [])).collect())


def test_contradicting_labels_are_toxic(spark, documents):
    """The model doesn't depend on the order of label rows; a doc_id marked both ways counts as toxic."""
    rows = [(k, f"you {'idiot' if k % 2 else 'friend'} number {k}") for k in range(60)]
    marks = [(k, k % 2) for k in range(60)]
    made = [toxicity.train(documents(rows), spark.createDataFrame(m, "doc_id bigint, toxic int"), queries.crc_rest(3) != 1) for m in (marks + [(1, 0), (3, 0)], [(3, 0), (1, 0)] + marks[::-1])]
    texts = pa.array([t for _, t in rows])
    assert (made[0].scores(texts) == made[1].scores(texts)).all() and (made[0].scores(texts) == toxicity.train(documents(rows), spark.createDataFrame(marks, "doc_id bigint, toxic int"), queries.crc_rest(3) != 1).scores(texts)).all()


def test_few_of_each(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 10 == 0, "rare").when(F.col("id") < 4990, "most").alias("kind"))
    few, counts = few_of_each(rows, "kind", 40)
    assert counts == {"rare": 500, "most": 4491, None: 9}
    want = rows.withColumn("h", F.xxhash64("doc_id")).toPandas().sort_values("h")
    for kind, n in (("rare", 40), ("most", 40), (None, 9)):
        got = [r.doc_id for r in few.where(F.col("kind").eqNullSafe(F.lit(kind))).orderBy("place").collect()]
        own = want[want.kind.isna()] if kind is None else want[want.kind == kind]
        assert got == own.doc_id.head(n).tolist() and len(got) == n


def test_resampling(spark, documents):
    rows = [(k, ("good clean words here " if k % 2 else "### zz %% junk ") * 8) for k in range(200)] + [(500, None), (501, ""), (None, "x"), (1, "good clean words here " * 8)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id bigint, quality int")
    got = resample.resample(documents(rows, "gumbel_key"), labels).collect()
    assert len(got) == len(rows) and abs(sum(r.selected for r in got) - len(rows) // 2) <= 1
    good = [r.selected for r in got if r.doc_id is not None and r.doc_id < 200 and r.doc_id % 2]
    assert sum(good) / len(good) > 0.8
    keys = resample.weighted(documents(rows), np.zeros(resample.BUCKETS))
    ordered = sorted((r.gumbel_key for r in keys.collect()), reverse=True)
    assert [resample.kth_largest(keys, "gumbel_key", k, parts=4) for k in (1, 2, 57, len(rows))] == [ordered[k - 1] for k in (1, 2, 57, len(rows))]
    assert resample.resample(documents([]), labels).count() == 0


def _grams(text):
    """Buckets of the words and word pairs of a text, one word at a time."""
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    one = []
    for w in words:
        raw = np.frombuffer(w, np.uint8)
        one.append(tx.word_hashes(raw, np.array([0]), np.array([len(raw)]))[0])
    with np.errstate(over="ignore"):
        pairs = [tx.mix(np.array([a * tx.BASE + b]))[0] for a, b in zip(one, one[1:])]
    return [int(g % np.uint64(resample.BUCKETS)) for g in one + pairs]


def test_resampling_against_brute_force(spark, documents):
    """Counts, log weights and the draw; a doc_id with contradicting labels counts as good, copies of an id count each."""
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(["Alpha", "beta", "gamma", "delta", "eps", "zeta"][k % 2 :]) for _ in range(rng.randint(0, 40)))) for k in range(120)]
    rows += [(7, "beta beta again"), (300, None), (301, ""), (None, "alpha beta"), (302, "long " * 20_000)]
    marks = [(k, int(k % 5 == 0)) for k in range(60)] + [(7, 0), (7, 1), (8, None), (None, 1), (999, 1), (302, 1)]
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int")
    got = resample.resample(documents(rows, "bits"), labels, share=0.25).collect()
    good = {k for k, q in marks if k is not None and q == 1}
    target, raw = np.ones(resample.BUCKETS), np.ones(resample.BUCKETS)
    for doc_id, text in rows:
        for g in _grams(text):
            raw[g] += 1
            target[g] += doc_id in good
    ratio = np.log((target / target.sum()) / (raw / raw.sum()))
    expected = sorted((repr(doc_id), len(_grams(text)), round(float(np.mean(ratio[_grams(text)])) * resample.STRENGTH if _grams(text) else 0.0, 9)) for doc_id, text in rows)
    assert sorted((repr(r.doc_id), r.n_ngrams, round(r.log_weight, 9) + 0.0) for r in got) == expected
    keys = sorted((r.gumbel_key for r in got), reverse=True)
    assert all(r.selected == (r.gumbel_key >= keys[round(0.25 * len(rows)) - 1]) for r in got)
    # the noise is the Gumbel quantile of a hash of the row
    noise = [r.gumbel_key - r.log_weight for r in got]
    assert -3 < min(noise) and abs(sum(noise) / len(noise) - 0.5772) < 0.5


def test_filter_lets_every_wanted_document_pass(documents, spark, monkeypatch):
    monkeypatch.setattr(resample, "FILTER_BITS", 64)
    docs = documents([(k % 50, f"text {k}") for k in range(200)] + [(None, "x")])
    ids = spark.createDataFrame([(k,) for k in range(0, 50, 3)] + [(-4,)], "doc_id bigint")
    assert sorted(r.text for r in resample.among(docs, ids).collect()) == sorted(f"text {k}" for k in range(200) if k % 50 % 3 == 0)


def test_ngram_counts(documents):
    docs = documents([(1, "a b a"), (2, None), (3, "A")])
    assert sum(r.n for r in resample.counts(docs).collect()) == 6


def test_blocks_of_ids():
    rng = np.random.Generator(np.random.PCG64(1))
    for n in (0, 1, 255, 256, 257, 3000):
        ids = rng.integers(0, 49_408, n).astype(np.uint32)
        ids[rng.random(n) < 0.02] = rng.integers(0, 2**32, 1).astype(np.uint32)
        raw, places = pfor.pack(ids)
        assert (pfor.unpack(raw, places) == ids).all()
    same = np.full(256, 7, np.uint32)
    assert len(pfor.pack(same)[0]) == pfor.BLOCK_HEAD.size


def test_id_files(documents):
    path = P.path("word_bpe_49k.json")
    rng = random.Random(6)
    rows = ODD + [(200 - k, "".join(rng.choice(["Word", "Ünï", " ", "  ", "\n", "don't", "!'s", "12a", "!?x", "é", "<|endoftext|>"]) for _ in range(rng.randrange(200)))) for k in range(60)]
    got = sorted(pfor.round_trip(documents(rows, "start"), path).collect(), key=lambda r: r.start)
    tokenizer = Tokenizer.from_file(path)
    assert tokenizer.encode("x <|endoftext|> y", add_special_tokens=False).ids == [343, 49407, 344]
    want, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == want
    assert pfor.round_trip(documents([]), path).count() == 0


PAGE = """<!doctype html><html><head><title>No</title><style>p{}</style><script>var a="</p><article>";</script></head><body>
<nav><ul><li><a href="/">Home</a><li><a href="/x">News</a></ul></nav><header>Site name</header><div class="cookie-notice">We use cookies on every page of ours</div>
<article><h1>Head &amp; shoulders</h1><!-- <p>gone</p> --><p>First <b>bold</b>  text<br>goes on &#233;
<p title="a > b">Second, <a href="q">linked</a>.<div class="ad">Buy now</div><form><label>Mail</label><input name=m></form><aside>Also read this</aside></article>
<section id="comments"><article><p>A reader says something long enough to look like text of its own</p></article></section><footer>&copy; all of it</footer></body></html>"""
BARE = "<body><div><a href=1>One</a> <a href=2>Two</a></div><div>" + "A paragraph of plain text that goes on for some time, as texts do. " * 3 + "</div><div>" + "And another one follows it, since articles have several of them. " * 3 + "</div><div><a href=3>Three</a> | <a href=4>Four</a></div>"


def test_main_text(spark):
    tree = html.train()
    assert html.main_text(PAGE, tree) == "Head & shoulders\nFirst bold text goes on é\nSecond, linked."
    assert [b[:11] for b in html.main_text(BARE, tree).split("\n")] == ["A paragraph", "And another"]
    rows = [(1, "u", PAGE, "x"), (2, None, None, "x"), (3, "u", "", "x"), (None, "u", "<<>< <p", "x"), (4, "u", "<article>" + "<div>deep " * 3000, "x"), (4, "u", "<p>" * 2000 + "</b>" * 2000, "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = html.extract(pages).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert html.extract(pages.limit(0)).count() == 0
    assert (tree.apply(html.labelled_table()[0]) == (html.labelled_table()[1] == 1)).all()


def prose(n, word="word"):
    return " ".join(f"{word}{k}" for k in range(n))


@pytest.mark.parametrize(
    ("page", "kept"),
    [
        (f"<div><h1>Head line</h1><p>{prose(40)}.</p><p>{prose(25)}</p></div><div><article>Teaser one</article><article>Teaser two</article></div>", ["Head line", prose(40) + ".", prose(25)]),
        (f"<nav><a>Home</a></nav><article><div class='reader-content'><h1>Title</h1><p>{prose(30)}</p></div></article><footer>Foot of it</footer>", ["Title", prose(30)]),
        (f"<main><section class='social-history'><p>{prose(30)}</p><p>{prose(8)}</p></section></main>", [prose(30), prose(8)]),
        (f"<nav><a>x</a></nav><article><h1>Head</h1><p>One.</p><p>{prose(45)}</p><ul><li><a>{prose(4, 'more')}</a></li><li><a>{prose(5, 'more')}</a></li></ul></article><footer>f</footer>", ["Head", "One.", prose(45)]),
        (f"<article><h1>Head</h1><p>{prose(80)}</p></article><section id=comments><article><p>{prose(30, 'reader')}</p></article></section>", ["Head", prose(80)]),
        (f"<div class=ad>{prose(12, 'buy')}</div><article><h1>Short</h1><p>Two words.</p></article><footer>{prose(9, 'foot')}</footer>", ["Short", "Two words."]),
        ("<p>just one short line</p>", ["just one short line"]),
        (f"<ul><li><a>{prose(2)}</a><li><a>{prose(1)}</a></ul><div hidden><p>{prose(50)}</p></div>", []),
    ],
)
def test_main_text_of_page_shapes(page, kept):
    assert html.main_text(page, html.train()) == "\n".join(kept)


def test_every_given_page_gives_its_article(spark, sf):
    """The given pages have one article of headings and paragraphs; its text is found again by plain regular expressions."""
    for row, page in zip(sorted(queries.QUERIES["op9_text_blocks"](spark, sf).collect(), key=lambda r: r.page_id), sorted(queries.table(spark, sf, "pages").collect(), key=lambda r: r.page_id)):
        body = re.search(r"<article>(.*)</article>", page.html, re.S)[1]
        body = re.sub(r"<br>", " ", re.sub(r"</?b>", "", body))
        parts = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", body)]
        assert row.text == "\n".join(p for p in parts if p)


def test_slices_join_to_the_column():
    from duepath.llm import text as tx

    column = pa.array(["ab", None, "c" * 50, "", "dé"])
    seen = [bytes(raw[a:b]).decode() for _, raw, to in tx.slices(column, 4) for a, b in zip(to[:-1], to[1:])]
    assert seen == ["ab", "", "c" * 50, "", "dé"]
