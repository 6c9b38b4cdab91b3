"""BPE, language ID, url models, rules and the classifier."""

import math
import random
import zlib
from collections import Counter, defaultdict

import frames
import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import bpe, langid, quality_model, quality_rules, queries, urls
from vellum.llm.common import table

SF = "/root/testdata/sf0.001"
WORDS = queries.vocabulary("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


def test_encoding_is_the_librarys(library):
    own = bpe.WordBpe(open(WORDS, "rb").read())
    rng = random.Random(1)
    alphabet = "aAbBéÉßΣσ's tred \n\t0１٣²-_.😀́̇İ日<|>\x1c"
    texts = ["", " ", "Hello's  World", "<|endoftext|>Hi<|startoftext|> x", "a" * 500, "ab" * 3000, "İΣΑΣ", "​　\x85", "foo_bar-baz", "\x00"]
    texts += ["".join(rng.choice(alphabet) for _ in range(40)) for _ in range(1500)]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        n, joined, decoded = own.encode_text(t)
        assert (n, joined) == (len(ids), " ".join(map(str, ids))), t
        assert decoded == library.decode(ids, skip_special_tokens=False) == own.decode(ids)


def test_every_character_is_the_librarys(library):
    own = bpe.WordBpe(open(WORDS, "rb").read())
    # a few characters of one kind at a time between letters, digits and marks; surrogates are no characters
    every = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x110000))]
    texts = [f"a{c}b {c}1!{c}?" for c in every if c.isprintable() or ord(c) < 0x32000]
    for at in range(0, len(texts), 50):
        text = " ".join(texts[at : at + 50])
        assert own.encode_text(text)[1] == " ".join(map(str, library.encode(text, add_special_tokens=False).ids)), hex(ord(texts[at][1]))


def test_what_is_rare_lies_far():
    later, _ = bpe.unknown()
    rare = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and bpe.RARE.match(chr(c))]
    assert rare and all(bpe.FAR.match(c) for c in (*rare, *later))


def test_combining_marks_are_the_librarys(library):
    import unicodedata

    marks = [chr(c) for c in range(0x1F000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c))[0] == "M"]
    rng = random.Random(2)
    for _ in range(20_000):
        text = rng.choice("aeoE") + "".join(rng.choice(marks) for _ in range(rng.randint(1, 4))) + rng.choice(["", "x", "\U00011935\U00011930"])
        assert bpe.lowered(text) == library.normalizer.normalize_str(text), [hex(ord(c)) for c in text]


def test_encoded_documents(spark, library):
    df = frames.documents(spark, extra=frames.CLASH)
    got = sorted((str(r.doc_id), r.n_tokens, r.token_ids) for r in bpe.encode_documents(df, WORDS).collect())
    want = []
    for r in df.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((str(r.doc_id), len(ids), " ".join(map(str, ids))))
    assert got == sorted(want)
    assert bpe.encode_documents(df.limit(0), WORDS).count() == 0


def test_forward_sums_all_segmentations():
    pieces = sorted(["▁", "▁a", "a", "b", "ab", "▁ab", "ba"])
    lattice = langid.Lattice(pieces)
    table_ = np.random.default_rng(0).random((len(pieces) + 2, 2))
    table_[-1] = 0

    def brute(word, k):
        if not word:
            return 1.0
        total = 0.0
        for n in range(1, len(word) + 1):
            if word[:n] in lattice_ids:
                total += table_[lattice_ids[word[:n]], k] * brute(word[n:], k)
            elif n == 1:
                total += table_[len(pieces), k] * brute(word[1:], k)
        return total

    lattice_ids = {p: i for i, p in enumerate(pieces)}
    words = ["▁ab", "▁abba", "▁a", "▁zab", "▁bz"]
    for places, grid in lattice.by_length(words):
        got = langid.forward(grid, table_)[-1]
        for i, row in zip(places, got):
            assert row == pytest.approx([brute(words[i], k) for k in range(2)])
        uses = langid.expected(grid, table_[:, :1], np.ones(len(places)))
        assert uses.sum() > 0 and uses[-1] == 0


def brute_log(word, ids, logs, unknown):
    """The word's log-probability in each language over all segmentations, end by end."""
    alpha = [np.zeros(logs.shape[1])]
    for e in range(1, len(word) + 1):
        ways = [alpha[e - n] + logs[ids[word[e - n : e]]] for n in range(1, min(e, 6) + 1) if word[e - n : e] in ids]
        if word[e - 1] not in ids:
            ways.append(alpha[e - 1] + logs[unknown])
        alpha.append(np.logaddexp.reduce(ways))
    return alpha[-1]


def test_long_words_sum_all_segmentations(monkeypatch):
    monkeypatch.setattr(langid, "CELLS", 500)  # segments of a few letters
    pieces = sorted(["▁", "▁a", "a", "b", "ab", "▁ab", "ba", "abab", "bbb", "babbab"])
    ids = {p: i for i, p in enumerate(pieces)}
    lattice = langid.Lattice(pieces)
    table_ = np.random.default_rng(0).random((len(pieces) + 2, 2)) * 1e-9
    table_[-1] = 0
    with np.errstate(divide="ignore"):
        logs = np.log(table_)
    rng = random.Random(5)
    words = ["▁" + "".join(rng.choice("abz") for _ in range(n)) for n in (17, 17, 40, 119, 120, 120, 2000)]
    model = langid.LanguageModel(pieces, ["x", "y"], table_)
    got = model.log_likelihoods([w[1:] for w in words])
    assert np.allclose(got, [brute_log(w, ids, logs, len(pieces)) for w in words], rtol=1e-12)
    # the posterior uses of long words agree with the derivative of the log-likelihood
    long, counts = words[4:6], np.array([3.0, 2.0])
    uses = langid.long_expected(lattice, long, logs[:, :1], counts)
    for piece in range(len(pieces) + 1):
        up, down = logs.copy(), logs.copy()
        up[piece] += 1e-5
        down[piece] -= 1e-5
        slope = sum(c * (brute_log(w, ids, up, len(pieces))[0] - brute_log(w, ids, down, len(pieces))[0]) for c, w in zip(counts, long)) / 2e-5
        assert uses[piece] == pytest.approx(slope, abs=1e-5)
    # and in words short enough for both ways
    plain = ["▁abbabab", "▁zabbabb"]
    (places, grid), = lattice.by_length(plain)
    assert np.allclose(langid.expected(grid, table_[:, :1], counts), langid.long_expected(lattice, plain, logs[:, :1], counts))


def plain_identify(rows, model_file, rounds=2, smooth=0.01):
    """Language identification by the book, in logarithms, one word and one language at a time."""
    pieces = langid.vocabulary_pieces(model_file)
    ids, unknown = {p: i for i, p in enumerate(pieces)}, len(pieces)
    longest = max(map(len, pieces))

    def words(text):
        return ["▁" + w for w in langid.LETTERS.findall(text.lower())]

    def cuts(word, e):
        for n in range(1, min(e, longest) + 1):
            at = ids.get(word[e - n : e], unknown if n == 1 else None)
            if at is not None:
                yield n, at

    def ahead(word, logs):
        alpha = [0.0]
        for e in range(1, len(word) + 1):
            alpha.append(np.logaddexp.reduce([alpha[e - n] + logs[at] for n, at in cuts(word, e)]))
        return alpha

    seen = defaultdict(Counter)
    for i, text, lang in rows:
        if text is not None and lang is not None and zlib.crc32(str(i).encode()) % 5:
            seen[lang].update(words(text))
    tables = {lang: np.full(unknown + 1, -np.log(unknown + 2)) for lang in sorted(seen)}
    for _ in range(rounds):
        for lang, counts in seen.items():
            logs, uses = tables[lang], np.full(unknown, smooth)
            for word, n_seen in counts.items():
                alpha, beta = ahead(word, logs), [-np.inf] * len(word) + [0.0]
                for e in range(len(word), 0, -1):
                    for n, at in cuts(word, e):
                        beta[e - n] = np.logaddexp(beta[e - n], beta[e] + logs[at])
                        if at < unknown:
                            uses[at] += n_seen * np.exp(alpha[e - n] + logs[at] + beta[e] - alpha[-1])
            tables[lang] = np.log(np.append(np.maximum(uses / uses.sum(), langid.FLOOR), 1e-7))
    out = []
    for i, text, _ in rows:
        if not text or not any(map(str.isalpha, text)):
            out.append((i, "und", 0.0))
            continue
        logs = {lang: sum(ahead(w, t)[-1] for w in words(text)) for lang, t in tables.items()}
        best = max(sorted(logs), key=logs.get)
        out.append((i, best, 1 / sum(np.exp(x - logs[best]) for x in logs.values())))
    return out


def test_languages_by_the_book(spark):
    rows = [(r.doc_id, r.text[:300] if r.text else r.text, r.lang) for r in table(spark, SF, "documents").limit(40).collect()]
    rows += [(900, "x" * 70, "en"), (901, None, "en"), (902, "12 34", "de"), (903, "ab " * 5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = queries.vocabulary("piece_bpe_32k.model")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(df, model).collect()}
    for i, lang, score in plain_identify(rows, model):
        assert got[i][0] == lang and got[i][1] == pytest.approx(score, abs=1e-9)


def test_languages(spark):
    model = queries.vocabulary("piece_bpe_32k.model")
    docs = table(spark, SF, "documents")
    out = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert np.mean([r.lang_pred == r.lang for r in held]) >= 0.95
    odd = frames.documents(spark, extra=frames.CLASH)
    got = langid.identify(odd, model).collect()
    assert len(got) == odd.count()
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in got if r.doc_id in (4, 5, 6, 11))
    assert all(r.lang_pred in ("en", "de", "fr") and 0 <= r.score <= 1 for r in got if r.doc_id in (1, 8, 10, 12, 13))
    kept = langid.keep_identified(odd, model)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, 7, 8, 9, 10, None, 12, 13}
    assert langid.identify(odd.limit(0), model).count() == 0
    assert {r.lang_pred for r in langid.identify(odd.withColumn("lang", F.lit(None).cast("string")), model).collect()} == {"und"}


def model_ratio(urls_, order=urls.ORDER):
    """A plain model of the two smoothed Markov models: (url, accepted) in, a scorer out."""
    seen = (defaultdict(Counter), defaultdict(Counter))
    for u, accepted in urls_:
        s = urls.START * order + u + urls.END
        for i in range(order, len(s)):
            for k in range(order + 1):
                seen[accepted][s[i - k : i]][s[i]] += 1

    def p(which, s, i):
        out = 1 / urls.ALPHABET
        for k in range(order + 1):
            c = seen[which].get(s[i - k : i])
            if c:
                n = sum(c.values())
                out = (c[s[i]] + len(c) * out) / (n + len(c))
        return out

    def score(u):
        s = urls.START * order + u + urls.END
        each = [round((math.log(p(1, s, i)) - math.log(p(0, s, i))) / urls.UNIT) for i in range(order, len(s))]
        return math.trunc(sum(each) / len(each))

    return score


RULE_CASES = [
    ("http://x.COM/en/1?q#f", "x.com", "/en/1", "com/en/", "block"), ("http://example.com/en/77", "example.com", "/en/77", "example.com/en/7", "allow"),
    ("https://a.example.com/en/8", "a.example.com", "/en/8", "com/en/", "block"), ("x://a.net/de/", "a.net", "/de/", "net/de/", "allow"),
    ("x://b.example.net/de/8", "b.example.net", "/de/8", "example.net/de/8", "block"), ("x://o.org/es/1", "o.org", "/es/1", "org/es/", "block"),
    ("x://xcom/en/1", "xcom", "/en/1", None, None), ("x://com/en/1://y", "com", "/en/1://y", "com/en/", "block"), ("no scheme.com/en/", "", "", None, None),
    (None, "", "", None, None), ("", "", "", None, None), ("a://h?x/y", "h", "", None, None), ("a://h#x/y", "h", "", None, None), ("a://", "", "", None, None),
    ("x://net/de", "net", "/de", None, None), ("x://ÄB.net/de/9", "Äb.net", "/de/9", "net/de/", "allow"),
]


def test_rules_of_urls(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(RULE_CASES)], "page_id long, url string").withColumn("rule", F.lit(1)).withColumn("u", F.lit(2))
    for r in urls.judge(df).collect():
        _, host, path, rule, verdict = RULE_CASES[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")
    assert urls.judge(df.limit(0)).count() == 0


def test_url_models(spark):
    pages = table(spark, SF, "pages").select("page_id", "url")
    pages = pages.union(pages.limit(5)).union(spark.createDataFrame([(10_000, None)], pages.schema))
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), (F.pmod(F.xxhash64(F.coalesce("url", F.lit("")), F.lit("hold")), F.lit(5)) == 0).alias("held"), urls.rule_for(urls.host(F.col("url")), urls.path(F.col("url"))).alias("fit")).collect()
    taught = {(r.url, int(r.fit.verdict == "allow")) for r in rows if r.fit and not r.held}
    score = model_ratio(taught)
    calibrate = [math.trunc(score(u) / 1000) for u in {r.url for r in rows if r.fit and r.held and r.fit.verdict == "allow"}]
    threshold = np.percentile(calibrate, 1) * 1000 if calibrate else None
    url = {r.page_id: r for r in rows}
    for r in urls.judge(pages).collect():
        own = url[r.page_id]
        if own.fit:
            assert (r.rule, r.verdict) == (own.fit.rule, own.fit.verdict)
        else:
            assert abs(r.score / urls.UNIT - score(own.url)) <= 2
            assert r.verdict == ("block" if threshold is not None and score(own.url) < threshold else "allow")


def test_long_and_repeated_urls(spark):
    rng = random.Random(7)
    rows = [(i, f"http://h{i % 3}.net/de/{rng.randint(0, 99)}") for i in range(60)] + [(100 + i, f"http://q{i}.com/en/{i}") for i in range(20)]
    rows += [(200, "x://h/" + "ab" * 20_000), (201, "x://h/" + "ab" * 20_000)] + [(300 + i, None) for i in range(200)]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert len(got) == len(rows) and got[200].path == "/" + "ab" * 20_000 and got[200].score == got[201].score
    assert len({(got[300 + i].host, got[300 + i].verdict, got[300 + i].score) for i in range(200)}) == 1


def test_rule_ledger(spark):
    df = frames.documents(spark, extra=frames.CLASH)
    got = quality_rules.judged(df)
    rows = {r.doc_id: r for r in got.collect()}
    assert got.count() == df.count() and rows[4].n_words == rows[5].n_words == rows[6].n_words == 0
    assert rows[4].base_failed and not rows[4].kept and rows[1].kept and rows[13].failed & quality_rules.bits(["word_length"])
    twelve = rows[12]
    assert (twelve.n_words, twelve.n_repeat_words, twelve.word_chars, twelve.base_failed) == (60, 60, 120, True)
    led = quality_rules.ledger(df).cache()
    failed = [r.failed for r in led.collect()]
    order = list(quality_rules.RULES)
    for r in quality_rules.ablations(led).collect():
        bit = 1 << order.index(r.rule)
        assert (r.failed, r.alone, r.kept_without) == (sum(bool(f & bit) for f in failed), sum(f == bit for f in failed), sum(f in (0, bit) for f in failed))
    base = quality_rules.apply_policy(led, "base").where("kept").count()
    assert base == sum(not f & quality_rules.bits(quality_rules.POLICIES["base"]) for f in failed)
    assert quality_rules.judged(df.limit(0)).count() == 0


def brute_repeats(words):
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(grams)
    return len({i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(3)})


def test_measurements(spark):
    rng = random.Random(8)
    rows = [(i, "".join(rng.choice(["a ", "b ", "c\n", "#! ", "ÄÖ!! ", "\t", "x|y "]) for _ in range(rng.randint(0, 60)))) for i in range(150)]
    got = {r.doc_id: r for r in quality_rules.judged(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        words = [w for w in t.replace("\t", " ").replace("\n", " ").split(" ") if w]
        lines = [x for x in t.split("\n") if x.strip(" \t")]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), brute_repeats(words))


def test_trees_learn_a_rule():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 5))
    y = ((x[:, 1] > 0.3) & (x[:, 3] < 0.8)).astype(float)
    trees = quality_model.boost(x[:1000], y[:1000])
    assert (((trees.score(x[1000:]) > 0.5) == y[1000:]).mean()) > 0.97
    assert (quality_model.boost(x[:0], y[:0]).score(x[:3]) == 0.5).all()


def plain_boost(x, y, trees, depth, bins, rate, ridge, least):
    """Gradient boosting by the book: every node tries every cut of every feature on its own rows."""
    base = math.log((sum(y) + 1) / (len(y) - sum(y) + 1))
    cuts = [sorted(set(np.quantile([r[f] for r in x], np.linspace(0, 1, bins + 1)[1:-1]).tolist())) for f in range(len(x[0]))]
    grown = []

    def grow(rows, g, h, level):
        def gain(some):
            return sum(g[i] for i in some) ** 2 / (sum(h[i] for i in some) + ridge)

        best = None
        for f in range(len(x[0])) if level < depth else ():
            for cut in cuts[f]:
                left, right = [i for i in rows if x[i][f] <= cut], [i for i in rows if x[i][f] > cut]
                if min(len(left), len(right)) >= least:
                    own = gain(left) + gain(right) - gain(rows)
                    if own > 1e-9 and (best is None or own > best[0] + 1e-9):
                        best = (own, f, cut, left, right)
        if best is None:
            return -rate * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + ridge)
        return best[1], best[2], grow(best[3], g, h, level + 1), grow(best[4], g, h, level + 1)

    def walk(node, row):
        while isinstance(node, tuple):
            node = node[3] if row[node[0]] > node[1] else node[2]
        return node

    def margin(row):
        return base + sum(walk(t, row) for t in grown)

    for _ in range(trees):
        p = [1 / (1 + math.exp(-margin(row))) for row in x]
        grown.append(grow(list(range(len(x))), [a - b for a, b in zip(p, y)], [a * (1 - a) for a in p], 0))
    return lambda row: 1 / (1 + math.exp(-margin(row)))


def test_trees_by_the_book():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(160, 4)).round(2)
    y = ((x[:, 0] + 0.4 * x[:, 1] * x[:, 2] + 0.3 * rng.normal(size=160)) > 0).astype(float)
    shape = {"trees": 5, "depth": 3, "bins": 8, "rate": 0.3, "ridge": 1.0, "least": 6}
    own, plain = quality_model.boost(x, y, **shape), plain_boost(x.tolist(), y.tolist(), **shape)
    new = rng.normal(size=(60, 4)).round(2)
    assert own.score(new) == pytest.approx([plain(r) for r in new.tolist()], abs=1e-9)


def test_quality(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    rows = quality_model.judge(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.predicted == r.quality for r in held]) >= 0.95
    odd = frames.documents(spark, extra=frames.CLASH)
    got = quality_model.judge(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert {r.score for r in quality_model.judge(odd, labels.limit(0)).collect()} == {0.5}
    assert quality_model.judge(odd.limit(0), labels).count() == 0


def test_languages_in_groups_give_the_same(spark, monkeypatch):
    letters = ["abcd", "efgh", "ijkl", "mnop", "qrst", "uvwx", "yzäö"]
    rng = random.Random(3)
    rows = [(k, " ".join("".join(rng.choice(letters[k % 7]) for _ in range(4)) for _ in range(6)), f"l{k % 7}") for k in range(140)]
    rows += [(900, None, "l1"), (901, "12 34", "l2"), (902, "", None), (903, "abcd qrst", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    pieces = queries.vocabulary("piece_bpe_32k.model")
    shown = lambda: sorted((r.doc_id, r.held_out, r.lang_pred, round(r.score, 9)) for r in langid.identify(df, pieces).collect())
    alone = shown()
    monkeypatch.setattr(langid, "GROUP", 3)
    assert shown() == alone and len(alone) == len(rows)
    assert langid.keep_identified(df, pieces).columns == df.columns


def test_six_hundred_languages(spark):
    # each language has words of its own
    own = [["".join(random.Random(100 * k + j).choices("abcdefghijklmnopqrstuvwxyz", k=9)) for j in range(6)] for k in range(600)]
    word = lambda k, j: own[k][j]
    rows = [(2000 * j + k, " ".join(word(k, i) for i in range(6)), f"l{k:03d}") for k in range(600) for j in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = langid.learn(df, queries.vocabulary("piece_bpe_32k.model"), rounds=1)
    known = df.where(~langid.held_out()).select("lang").distinct().count()
    assert sum(len(m.languages) for m in models) == known > 590 and max(len(m.languages) for m in models) <= langid.GROUP
    got = langid.told(df.where("doc_id < 600 AND doc_id % 30 = 0"), models, "p").select("lang", "p.*").collect()
    assert len(got) == 20 and sum(r.lang == r.lang_pred for r in got) >= 18


def test_a_labelled_document_of_many_rows_counts_once(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    labels = table(spark, SF, "labels").select("doc_id", "quality")
    often = labels.where(~quality_model.held_out()).orderBy("doc_id").first()["doc_id"]
    many = docs.unionByName(docs.where(F.col("doc_id") == often).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(5000)))).drop("n"))
    once, again = quality_model.learn(docs, labels), quality_model.learn(many, labels)
    assert (once.feature == again.feature).all() and (once.value == again.value).all()
