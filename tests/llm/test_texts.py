"""Packing, benchmark search, licenses, URL rules and languages, against brute force."""

import itertools
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from studyweave.llm import decontamination, language, licenses, packing, url_rules


@pytest.fixture(scope="module")
def tokenizer():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return public_tokenizers.path("word_bpe_49k.json")


def test_chunks_give_the_tokenizers_ids(tokenizer):
    from tokenizers import Tokenizer

    whole, chunks = Tokenizer.from_file(tokenizer), packing.Chunks(tokenizer, most=50)
    rng = random.Random(1)
    signs = [*" \t\n\r\x0b\x0c\x1c\x85\xa0\u3000'stdm AáÉΣσİıßé12#$日\u0300.,!", "<|endoftext|>", "'s", "word. ", "WORD,\n", "é. "]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 16))) for _ in range(3000)] + ["x" * 500, "Hello, world! It's 2024."]
    for text in texts:
        assert np.frombuffer(chunks.ids(text.encode()), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_decomposed_capitals_give_the_tokenizers_ids(tokenizer):
    from tokenizers import Tokenizer

    whole, chunks = Tokenizer.from_file(tokenizer), packing.Chunks(tokenizer)
    rng = random.Random(8)
    signs = ["J\u030c", "H\u0331", "T\u0308", "W\u030a", "Y\u030a", "J\u0591\u030c", "I\u0307", "A", "b", "\u00c9", " ", ". ", "\u0301", "<|", "D"]
    texts = signs[:6] + ["".join(rng.choice(signs) for _ in range(rng.randint(1, 9))) for _ in range(2000)]
    for text in texts:
        assert np.frombuffer(chunks.ids(text.encode()), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, ascii(text)


def test_signs_after_words_are_looked_up_on_their_own(tokenizer):
    from tokenizers import Tokenizer

    whole, chunks, asked = Tokenizer.from_file(tokenizer), packing.Chunks(tokenizer), []
    chunks.encode = lambda text, **named: asked.append(text) or whole.encode(text, **named)
    rng = random.Random(5)
    signs = ["***", "$$$", ".%%%", "!!", "&&&", "<|", "|>", "(", "_", *map(chr, range(33, 39)), *"()*+,-./:;<=>?@[\\]^_`{|}~"]
    words = ["".join(rng.choice("abczXYZéÀßÿñ") for _ in range(rng.randint(1, 9))) for _ in range(400)] + ["word", "Ærøskøbing"]
    texts = [rng.choice(words) + rng.choice(signs) for _ in range(4000)] + [w + "".join(rng.choices(signs[4:], k=3)) for w in words]
    for text in texts:
        wanted = whole.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(chunks.ids(text.encode()), "<u4").tolist() == wanted, text
    assert not any(c.isalpha() for text in asked for c in text) and len(asked) <= len(set(signs)) + len(words)
    for text in (" ".join(texts[:500]), "endoftext<|endoftext|> a's* it's, x's! 'll\" don't. é's' a\u0300* <\u0338", "<|startoftext|>** a<|endoftext|>*"):
        assert np.frombuffer(chunks.ids(text.encode()), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_packing_is_a_partition_without_padding(spark, tokenizer):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["alpha", "beta.", "Gamma", "7"]) for _ in range(rng.choice([0, 1, 5, 60, 400, 5000]))) for _ in range(150)] + [None, ""]
    rows = [(k, t, 1) for k, t in enumerate(texts)] + [(None, "no id", 1), (3, "again", 1)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, sequence_id int").repartition(3)
    out = packing.pack(docs, tokenizer, capacity=512, block=2000).collect()
    chunks = packing.Chunks(tokenizer)
    wanted = sorted((k if k is not None else -1, chunks.ids((t or "").encode()) + b"\x02\0\0\0") for k, t, _ in rows if k != 3)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    joined = sorted((k if k is not None else -1, b"".join(bytes(r.ids) for r in sorted(rs, key=lambda r: r.start))) for k, rs in pieces.items() if k != 3)
    assert joined == wanted
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += len(r.ids) // 4
        assert at <= 512
        assert at & (at - 1) == 0
    assert packing.pack(spark.createDataFrame([], "doc_id int, text string"), tokenizer).collect() == []


def test_packer_takes_the_cheapest_sequence_with_room():
    packer = packing.Packer(10, 1.0, 0.1)
    rows = [(n, b"\0\0\0\0" * n) for n in (7, 6, 4, 3)]
    got = [(row, start, len(ids) // 4, sequence, offset) for row, start, ids, sequence, offset, _ in packer.pack(rows, True)]
    assert got == [(7, 0, 7, 0, 0), (6, 0, 6, 1, 0), (4, 0, 4, 1, 6), (3, 0, 3, 0, 7)]


def edit_distance(item, text):
    row = [0] * (len(text) + 1)
    for k, a in enumerate(item, 1):
        now = [k]
        for j, b in enumerate(text, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (a != b)))
        row = now
    return min(row), row.index(min(row))


def test_bit_parallel_distance_is_the_edit_distance():
    rng = random.Random(3)
    for _ in range(1500):
        item = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 25)))
        assert decontamination.distance(item, text) == edit_distance(item, text)


def test_edited_items_are_found_and_no_others(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    items = [(k, " ".join(word() for _ in range(rng.randint(8, 40)))) for k in range(20)]
    rows = []
    for k in range(120):
        parts = [word() for _ in range(rng.randint(0, 60))]
        if k % 3:
            text = list(rng.choice(items)[1])
            for _ in range(rng.randint(0, len(text) // 12)):  # some beyond the edits allowed
                at = rng.randrange(len(text))
                text[at : at + 1] = rng.choice([[], ["x"], [text[at], "y"]])
            parts.insert(rng.randint(0, len(parts)), "".join(text))
        rows.append((k, "  ".join(parts), 0))
    rows += [(500, None, 0), (501, "", 0), (None, items[0][1].upper(), 0), (502, (items[1][1] + "! ") * 300, 0), (502, items[2][1], 0)]
    bench = [*items, (90, None), (91, ""), (92, "short"), (None, "an item without id that is long enough")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, leaks int")
    for block in (5, 5000):
        marked = decontamination.mark(docs, spark.createDataFrame(bench, "item_id int, text string"), block=block)
        assert marked.columns == ["doc_id", "text", "leaks"]
        got = defaultdict(set)
        for r in marked.collect():
            got[r.doc_id, r.text] |= {(x.item_id, x.distance) for x in r.leaks}
        for doc_id, text, _ in rows:
            plain, wanted = decontamination.plain(text or ""), set()
            if len(plain) < 3000:
                for item_id, item in items:
                    item = decontamination.plain(item)
                    d, _ = edit_distance(item, plain)
                    if d <= len(item) // 16:
                        wanted.add((item_id, d))
                assert got[doc_id, text] == wanted
        assert (1, 0) in got[502, rows[-2][1]]
    none = spark.createDataFrame([], "item_id int, text string")
    assert decontamination.leaks(docs.drop("leaks"), none).collect() == []
    assert decontamination.leaks(spark.createDataFrame([], docs.schema), spark.createDataFrame(items, none.schema)).collect() == []


def test_short_items_are_found_between_word_borders(spark):
    items = ["Who am I?", "7", "\u5929\u7a7a\u662f\u4ec0\u4e48\u989c\u8272\uff1f", "cat", "What is a monad?", "?!", "", "a a"]
    texts = {
        "so: who AM i.": {0}, "Whom am I": set(), "17 and 77": set(), "(7)": {1}, "\u8bf7\u95ee\u5929\u7a7a\u662f\u4ec0\u4e48\u989c\u8272\u554a": {2},
        "concat cats": set(), "concat, Cat": {3}, "\u732bcat\u732b": {3}, "7 cat": {1, 3}, "I asked what is a monad": {4}, "what is a nomad": set(), "ba a ab": set(), "ba a a a": {7}, "": set(),
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = decontamination.leaks(docs, spark.createDataFrame(list(enumerate(items)), "item_id int, text string")).collect()
    plain = [decontamination.plain(x) for x in texts]
    for k, (text, wanted) in enumerate(texts.items()):
        assert {r.item_id for r in found if r.doc_id == k} == wanted, text
    assert all(r.distance == 0 and plain[r.doc_id][r.start : r.end] == decontamination.plain(items[r.item_id]) for r in found)


def test_licenses_match_containment(spark):
    rng = random.Random(2)
    word = lambda: rng.choice(["the", "code", "license", "work", "may", "x1", "Ünder", "granted"])
    names = list(licenses.TEMPLATES)
    rows = []
    for k in range(150):
        name = rng.choice(names)
        text = licenses.TEMPLATES[name]
        if k % 3 == 1:  # change some words
            parts = text.split()
            parts[rng.randrange(len(parts))] = "other"
            text = " ".join(parts)
        pad = lambda: " ".join(word() for _ in range(rng.randint(0, 80)))
        rows.append((k, f"{pad()}\n{text.upper() if k % 5 == 0 else text}\n{pad()}" if k % 4 else pad(), "v"))
    rows += [(700, None, ""), (701, "", ""), (702, "All", ""), (None, "All rights reserved.", ""), (703, "all rights reserved " * 4000, "")]
    got = {(r.doc_id, r.license): r for r in licenses.scan(spark, spark.createDataFrame(rows, "doc_id int, text string, license string")).collect()}
    sure, possible = set(), set()
    for doc_id, text, _ in rows:
        words = licenses.words(text or "")
        runs = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)]
        for name, template in licenses.TEMPLATES.items():
            t = licenses.words(template)
            known = {" ".join(t[k : k + 3]) for k in range(len(t) - 2)}
            m = licenses.size_class(len(known))
            for k in range(0, len(runs), m):  # the windows
                if len(known & set(runs[k : k + 2 * m])) / len(known) >= 0.8:
                    possible.add((doc_id, name))
            if f" {' '.join(t)} " in f" {' '.join(words)} ":
                sure.add((doc_id, name))
    assert sure <= set(got) <= possible
    assert len(possible - set(got)) <= 0.01 * len(possible)
    assert all(r.containment >= 0.8 and r.windows > 0 for r in got.values())
    assert licenses.scan(spark, spark.createDataFrame([], "doc_id int, text string")).collect() == []
    for n in (1, 3, 5, 16, 47):  # the bands guarantee the recall at the least similarity
        similar = 0.8 * n / (2 * licenses.size_class(n) + 0.2 * n)
        assert 1 - (1 - similar) ** licenses.bands(n, 0.8, 0.999) >= 0.999


def test_inserted_words_lose_no_license_at_any_place(spark):
    rows, wanted = [], set()
    power = " ".join(f"own{k}" for k in range(18))  # 16 shingles, no less than its size class
    templates = {x: licenses.TEMPLATES[x] for x in ("mpl-2.0", "gpl-3.0-short", "cc-by")} | {"power": power}
    for name, template in templates.items():
        t = licenses.words(template)
        known = {" ".join(t[k : k + 3]) for k in range(len(t) - 2)}
        m = licenses.size_class(len(known))
        for inserted in (5, 8, m + 1):
            for place in range(1, len(t)):
                parts = t[:place] + [f"in{k}" for k in range(inserted)] + t[place:]
                if len(known & {" ".join(parts[k : k + 3]) for k in range(len(parts) - 2)}) < 0.8 * len(known):
                    continue
                for before in range(m):
                    wanted.add((len(rows), name))
                    rows.append((len(rows), " ".join([f"pad{k}" for k in range(before)] + parts + ["end"] * 40)))
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(8)
    got = {(r.doc_id, r.license) for r in licenses.scan(spark, docs, templates, recall=1 - 1e-6).collect()}
    assert wanted <= got
    for n in (1, 3, 5, 16, 47):
        similar = 0.8 * n / (3 * licenses.size_class(n) + 0.2 * n)
        assert 1 - (1 - similar) ** licenses.bands(n, 0.8, 0.999) >= 0.999


RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def brute_judge(url):
    if not url or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = "".join(c.lower() if c.isascii() else c for c in rest.split("/")[0].split("?")[0].split("#")[0])
    tail = rest.split("#")[0].split("?")[0]
    path = tail[tail.index("/") :] if "/" in tail else ""
    fit = [(len(h) + len(p), h + p, v) for v, h, p in RULES if (host == h or host.endswith(f".{h}")) and path.startswith(p)]
    return host, path, *(max(fit)[1:] if fit else (None, None))


def test_urls_by_listed_and_mined_rules(spark):
    rng = random.Random(5)
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.NET/EN/a", "https://a.example.net/en/x?b=1#c", "x://net", "x://net/", "x://example.com/de/", "x://notexample.com/de/", "x://a.org?/fr/", "x://a.org/fr/#?", "://É.net/a", "x://host#frag/fr/", "x://h?q=/fr/", "x://a.org/fr"]
    urls += [f"https://{rng.choice(['m.', ''])}{rng.choice(['spam', 'good', 'shop'])}.example.{rng.choice(['com', 'org', 'net'])}/{rng.choice(['de', 'en', 'fr'])}/{rng.randint(1, 99)}" for _ in range(400)]
    rows = [(k, u, "mine") for k, u in enumerate(urls)] + [(3, urls[3], "mine"), (None, "x://spam.example.org/en/1", "mine")]
    labels = [(k, "block" if "spam" in (u or "") else "allow") for k, u in enumerate(urls) if k % 2] + [(None, "block"), (1, "block"), (2, None)]
    judge = lambda some, marks: url_rules.judge(spark, spark.createDataFrame(some, "page_id int, url string, verdict string"), RULES, spark.createDataFrame(marks, "id int, verdict string"), support=0.02, least=1)
    out = judge(rows, labels)
    assert out.columns == ["page_id", "url", "host", "path", "rule", "verdict", "mined"]
    got = out.collect()
    assert len(got) == len(rows)
    # mined rules by counting all combinations of up to four tokens
    tokens = {r.url: set(r.t) for r in spark.createDataFrame([(u,) for u in {u for _, u, _ in rows}], "url string").select("url", url_rules.tokens(F.coalesce("url", F.lit(""))).alias("t")).collect()}
    given = {k: max(v for i, v in labels if i == k and v) for k in {i for i, v in labels if i is not None and v}}
    baskets = [(tokens[u], brute_judge(u)[3] or given.get(k)) for k, u, _ in rows]
    baskets = [(t, v) for t, v in baskets if v]
    held, bad = defaultdict(int), defaultdict(int)
    for t, v in baskets:
        for size in range(1, 5):
            for some in itertools.combinations(sorted(t), size):
                held[some] += 1
                bad[some] += v == "block"
    least = -(-2 * len(baskets) // 100)
    sure = [set(some) for some in held if bad[some] >= least and bad[some] >= 0.9 * held[some]]
    for r in got:
        host, path, rule, verdict = brute_judge(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        fits = any(s <= tokens[r.url] for s in sure)
        assert r.verdict == (verdict or ("block" if fits else "allow")), r
        assert verdict or (r.mined is not None) == fits
    assert any(r.mined for r in got)
    assert [r.verdict for r in judge(rows[:3], []).collect()] == ["allow"] * 3
    assert judge([], []).collect() == []


def test_every_host_has_a_token_of_its_own(spark):
    urls = [("http://a.b.c.d.e.f/x",), ("http://d.e.f/",), ("http://a.b.c.d/",), ("no address",), (None,)]
    rows = spark.createDataFrame(urls, "url string").select(url_rules.tokens(F.coalesce("url", F.lit(""))).alias("t")).collect()
    hosts = [{x for x in r.t if x.startswith("host:")} for r in rows]
    assert hosts == [{"host:f", "host:e.f", "host:d.e.f", "host:a.b.c.d.e.f"}, {"host:f", "host:e.f", "host:d.e.f"}, {"host:d", "host:c.d", "host:b.c.d", "host:a.b.c.d"}, set(), set()]


def test_language_fusion_matches_its_formula(spark):
    rng = random.Random(4)
    word = {"aa": ["lorem", "ipsum", "dolor"], "bb": ["zwei", "drei", "kühl"]}
    say = lambda lang, n: " ".join(rng.choice(word[lang]) for _ in range(n))
    docs = spark.createDataFrame([(k, say(x, 40), x) for k, x in enumerate(["aa", "bb"] * 20)] + [(90, None, "aa"), (91, "x", None)], "doc_id int, text string, lang string")
    rows = []
    for k in range(60):
        lang = rng.choice(["aa", "bb"])
        said = rng.choice([f'<html lang="{lang}">', "<html>", f"<HTML class=x LANG='{lang}-XY'>"])
        rows.append((k, f"https://{'h' + lang if k % 3 else 'mixed'}.site.{'de' if lang == 'bb' else 'com'}/", f"{said}<script>zwei drei</script><p>{say(lang, rng.choice([0, 1, 30]))}</p>", "old"))
    rows += [(70, None, None, "old"), (71, "", "", "old"), (None, "x://haa.site.com", '<html lang="aa">', "old")]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string, language string")
    out = language.identify(spark, pages, language.fit(docs))
    assert out.columns == ["page_id", "url", "language"]
    got = {r.page_id: r.language for r in out.collect()}
    langs, chances = language.fit(docs)
    assert langs == ["aa", "bb"]
    seen = []
    for page, url, html, _ in rows:
        raw = (html or "").encode()
        counts = language.triples(language.shown(raw))
        score = counts @ chances * min(1, 48 / max(1, counts.sum()))
        share = np.exp(score - score.max())
        host = url.split("://")[1].split("/")[0] if url else ""
        parts = host.split(".")
        seen.append((page, share / share.sum(), {"host": host, "domain": ".".join(parts[-2:]), "suffix": parts[-1], "said": language.declared(raw)}))
    total = sum(s for _, s, _ in seen)
    for page, share, keys in seen:
        less = {by: sum(s for _, s, k in seen if k[by] == keys[by]) - share for by in keys}
        rest = total - share
        base = (rest + 1) / (rest.sum() + 2)
        domain = (less["domain"] + 10 * base) / (less["domain"].sum() + 10)
        prior = (less["host"] + 10 * domain) / (less["host"].sum() + 10)
        odds = share * prior * (less["said"] + 1) / (rest + 10) * (less["suffix"] + 1) / (rest + 10)
        assert got[page].lang == langs[int(np.argmax(odds))]
        assert got[page].confidence == pytest.approx(odds.max() / odds.sum())
        assert (got[page].declared, got[page].suffix, got[page].host) == (keys["said"], keys["suffix"], keys["host"])
    assert language.identify(spark, spark.createDataFrame([], pages.schema), (langs, chances)).collect() == []
    nothing = language.identify(spark, pages, language.fit(spark.createDataFrame([], docs.schema))).collect()
    assert len(nothing) == len(rows)
    assert nothing[0].language.lang is None


def test_the_root_declares_wherever_it_is():
    say = language.declared
    assert say(b"<!-- " + b"x" * 100_000 + b" -->\n<html lang=de>") == "de"
    assert say(b" " * 70_000 + b"<HTML class='a' LANG='fr-CA'>") == "fr"
    assert say(b"<!-- <html lang=xx> --><!----><html lang=de>") == "de"
    assert say(b"<html><p>&lt;<code><html lang=xx></code>") == ""
    assert say(b"<!-- open <html lang=de>") == "de"
    assert say(b"<!--" * 200_000) == say(b"<html " * 200_000) == say(b"") == ""


def test_plain_text_has_no_marks(spark):
    docs = spark.createDataFrame([(1, "lorem ipsum dolor", "aa"), (2, "zwei drei kurz", "bb")], "doc_id int, text string, lang string")
    text = "a < b " + "zwei drei kurz " * 5 + "c > d <!-- lorem"
    pages = spark.createDataFrame([(1, "source://s", text), (2, "source://s", "<html lang=aa> zwei drei kurz")], "page_id int, url string, html string")
    model = language.fit(docs)
    plain = {r.page_id: r.language for r in language.identify(spark, pages, model, plain=True).collect()}
    assert [(plain[k].text_lang, plain[k].declared) for k in (1, 2)] == [("bb", "")] * 2
    marked = {r.page_id: r.language for r in language.identify(spark, pages, model).collect()}
    assert (marked[1].text_lang, marked[2].declared) == ("aa", "aa")


def test_rare_languages_are_told_apart(spark):
    rng = random.Random(10)
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    names = [a + b for a in "abcdef" for b in alphabet][:60]
    word = {x: ["".join(rng.choice(alphabet) for _ in range(7)) for _ in range(3)] for x in names}
    say = lambda x: " ".join(rng.choice(word[x]) for _ in range(30))
    rows = [(k, say("aa"), "aa") for k in range(300)] + [(None, say("ab"), "ab"), (None, say("ab"), "ab")]
    rows += [(1000 + 2 * k + j, say(x), x) for k, x in enumerate(names[2:]) for j in range(2)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    langs, chances = language.fit(docs, sample=50)
    assert langs == names
    own = [k for k, x in enumerate(names) if (language.triples(say(x).encode()) @ chances).argmax() == k]
    assert own == list(range(60))
    first = spark.createDataFrame([(r[0],) for r in rows[:300]], "id int").orderBy(F.xxhash64("id")).limit(50).collect()
    counts = 0.1 + sum(language.triples(rows[r.id][1].encode()) for r in first)
    assert np.allclose(chances[:, 0], np.log(counts / counts.sum()))
    pages = spark.createDataFrame([(k, f"x://h{k}.t{k}", say(x)) for k, x in enumerate(names)], "page_id int, url string, html string")
    got = {r.page_id: r.language.lang for r in language.identify(spark, pages, (langs, chances)).collect()}
    assert [got[k] for k in range(60)] == names


def test_required_words_are_in_any_sufficient_part():
    for text in licenses.TEMPLATES.values():
        words = licenses.words(text)
        shingles = sorted({" ".join(words[k : k + 3]) for k in range(len(words) - 2)})
        chosen = licenses.required(shingles, 0.8)
        without = [s for s in shingles if not set(chosen) & set(s.split())]
        assert len(without) < 0.8 * len(shingles)
