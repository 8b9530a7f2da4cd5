"""Merkle manifest, main text of pages and phrase mining, each against a brute-force version, and their special cases."""

import random
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee.llm import htmltext, merkle, oracle, phrases, queries
from marquee.llm.common import table


def h(text):
    return sha256(text.encode()).hexdigest()


# ---------------------------------------------------------------- against SQL


@pytest.mark.parametrize("name", ["op11_merkle", "op12_htmltext", "op13_phrases"])
def test_query_equals_its_statement(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf)
    want = con.sql(oracle.ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)


# ---------------------------------------------------------------- 11


def slow_tree(nodes):
    """Root and, of every node, the siblings on its way up as (left, right)."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = i - i % 8
            ways[k].append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + 8])))
            at[k] = i // 8
        nodes = [h("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
    return nodes[0], ways


def slow_manifest(rows, fields):
    """rows: dicts. (doc_id, leaf, subroot, root, proof, folded_root) of each."""
    one = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: h("".join(one(r[c]) for c in fields))
    lower = lambda t: None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    groups = defaultdict(list)
    for r in rows:
        groups[r["lang"]].append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[g] = slow_tree([leaf(r) for r in groups[g]])
    root, tops = slow_tree([trees[g][0] for g in order]) if order else (None, [])
    out = []
    for k, g in enumerate(order):
        for r, way in zip(groups[g], trees[g][1]):
            way = way + tops[k]
            changed = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
            node = leaf({**r, "text": lower(r["text"])}) if changed else leaf(r)
            for a, b in way:
                node = h(a + node + b)
            out.append((r["doc_id"], leaf(r), trees[g][0], root, h("".join(a + b for a, b in way)), node))
    return out


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def made(docs):
    found = merkle.leaves(docs, FIELDS, "doc_id", "lang", F.crc32(F.col("doc_id").cast("string")) % 3 == 0, {"text": F.translate("text", queries.UPPER, queries.LOWER)})
    layers, paths, root = merkle.manifest(found)
    return [(r.id, r.leaf, r.subroot, root, r.proof, r.copied[-1] if r.copied else r.tampered or r.leaf) for r in merkle.versions(layers, paths).collect()]


def test_merkle_special_cases(odd_docs, no_docs):
    rows = [r.asDict() for r in odd_docs.collect()]
    assert sorted(made(odd_docs), key=repr) == sorted(slow_manifest(rows, FIELDS), key=repr)
    assert made(no_docs) == []


@pytest.mark.parametrize("n", [1, 9, 512, 4097])
def test_merkle_sizes(spark, n):
    """One group that holds nearly all rows, blocks that end anywhere, a last run of one node."""
    docs = spark.createDataFrame([(i * 7 % 5000, f"Text {i % 40}", "en" if i % 97 else "fr", None, i) for i in range(n)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    assert sorted(made(docs)) == sorted(slow_manifest([r.asDict() for r in docs.collect()], FIELDS))


def test_merkle_versions_share_what_they_do_not_copy(spark):
    docs = spark.createDataFrame([(i, f"T{i}", "en", "s", 2) for i in range(600)], "doc_id long, text string, lang string, source string, n_chars long")
    found = merkle.leaves(docs, FIELDS, "doc_id", "lang", F.col("doc_id") == 333, {"text": F.lit("x")})
    layers, paths, root = merkle.manifest(found)
    rows = merkle.versions(layers, paths).orderBy("id").collect()
    same = [r for r in rows if r.id != 333]
    assert all(r.copied[-1] == root for r in same) and rows[333].copied[-1] != root
    own = set(rows[333].copied)
    assert len(own) == 4 and not own & {n for r in same for n in r.copied}


# ---------------------------------------------------------------- 12

P = "It was a long day, and the sun, which had been hiding, finally came out over the hills of the town."
PAGES = [
    ("", ""),
    (None, ""),
    ("<nav><a href=1>a</a></nav>", ""),
    ("plain text, only &amp;lt; &#8364;&nbsp;x", "plain text, only &lt; € x"),
    (f"<body><header><h1>Site</h1></header><div id=wrap><div class=sidebar><p>{P}</p></div><h1>T</h1><div class=c><p>{P}<p>x<ul><li>one<li>two</ul><table><tr><td>a<td>b</table></div><div class='comments'><p>{P}{P}</div></div><footer>(c)</footer>", f"T {P} x one two a b"),
    (f"<main><h1>T</h1><p>{P}</p><div><div><p>{P}</p></div><div><p>{P}</p></div></div><section id='comments'><h2>3 comments</h2><p>{P}</p></section></main>", f"T {P} {P} {P}"),
    (f"<div class='page with-sidebar'><div class='content'><p>{P}</p><pre>a\n  b</pre><blockquote>q<p>r</blockquote></div><aside>{P}</aside></div>", f"{P} a b q r"),
    (f"<html><head><title>x</title><body><ul><li><a href=a>Home page</a><li><a href=b>News</a></ul><div><p>{P}</p><p>{P}</p></div><ul><li><a href=a>Imprint of the</a><li><a href=b>News</a></ul>", f"{P} {P}"),
    (f"<article><header><p>By A. N.</header><p>a<b>b</b>c <i>d</i></p><div class=share><a>x</a></div><form><p>{P}</form><p>z</article><article class=comment><p>{P}{P}{P}</article>", "abc d z"),
    (f"<div><p>{P}</p></div><div><p>{P}</p></div>", f"{P} {P}"),
    ("<article><h1>A &am</h1><p>t &amp b<script>var a='</p>';</script> c <!-- <p>x --> d</p><style>x", "A &am t & b c d"),
    (f'<div data-x="a>b"><p title=\'<p>\'>{P}</p></div>', P),
    (f"<div class='cookie-notice'><p>{P}{P}</p></div><div><p>short.</p></div>", "short."),
    (f"<noscript>{P}</noscript><div role=banner>{P}</div><div hidden>{P}</div><div style='display: none'>{P}</div><p>ok</p>", "ok"),
    (f"<table><tr><td><a href=1>Menu one</a><br><a href=2>Menu two</a></td><td><p>{P}</p><p>{P}</p></td></tr></table>", f"{P} {P}"),
    ("<article><h1>T</h1><p><b>First.<br><p>Second</p>", "T First. Second"),
    ("<article><p>" + "word " * 200_000 + "</p></article>", "word " * 199_999 + "word"),
    ("<div>" * 20_000 + "deep" + "</div>" * 20_000, "deep"),
    ("<article>3 < 4 and <5, x</p> y</article>", "3 < 4 and <5, x y"),
    (f"<div><h1>T</h1><p>{P}</p><h2>Comments on the law</h2><p>x</p><h3>Comments (2)</h3><div><p>{P}</p></div><p>{P}{P}</p></div>", f"T {P} Comments on the law x"),
    (f"<main><p>{P}</p><div itemscope itemtype='https://schema.org/Comment'><p>{P}</p></div><div aria-label='Cookie notice'>{P}</div><ol class=commentlist><li>{P}</ol></main>", P),
    (f"<article><h2>Kommentare</h2><p>{P}</p></article><p>{P}</p>", P),
]


def test_main_text_of_layouts(spark):
    pages = spark.createDataFrame([(i, f"u{i}", html, "x", 1) for i, (html, _) in enumerate(PAGES)] + [(None, None, PAGES[1][0], "", 0)], "page_id long, url string, html string, text string, id int")
    got = htmltext.main_texts(pages).collect()
    assert [r.text for r in got if r.id is not None] == [want for _, want in PAGES]
    assert htmltext.main_texts(pages.limit(0)).collect() == []
    assert htmltext.main_texts(pages.unionAll(pages)).count() == 2 * len(got)


def test_every_word_of_an_article_stays(spark, sf):
    """Tags and references put into the tables' own texts come out again."""
    import html

    texts = [" ".join((r.text or "").split()) for r in table(spark, sf, "documents").select("text").collect()]
    rng = random.Random(3)
    rows = []
    for i, t in enumerate(texts):
        words = [f"<{tag}>{html.escape(w)}</{tag}>" if (tag := rng.choice(["b", "em", "", "", "", "span"])) else html.escape(w) for w in t.split(" ")]
        cuts = sorted(rng.sample(range(len(words) + 1), min(5, len(words))))
        paragraphs = [" ".join(words[a:b]) for a, b in zip([0, *cuts], [*cuts, len(words)])]
        rows.append((i, "u", f"<html><nav><a href=/>x</a></nav><div class=ad>{P}</div><article>" + "".join(f"<p>{p}" for p in paragraphs) + f"</article><div class=comments><p>{P}</div><footer>f"))
    got = htmltext.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("id").collect()
    assert [r.text for r in got] == texts


# ---------------------------------------------------------------- 13


def slow_phrases(rows, support, longest, top, keep=100):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang, text = "und" if lang is None else lang, low(text)
        for c in ".,;:!?\n\x0b\x0c\r":
            text = text.replace(c, "\0BREAK\0")
        for piece in text.split("\0BREAK\0"):
            ws = [w for w in piece.replace("\t", " ").split(" ") if w]
            n[lang] += len(ws)
            for k in range(1, longest + 1):
                f[lang].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, c in f.items():
        big = {p: x for p, x in c.items() if x >= support}
        found = []
        for p, a in big.items():
            if len(p) < 2 or any(len(q) > len(p) and 100 * x >= keep * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, x in big.items()):
                continue
            score, _, l, r = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def rows_of(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


@pytest.mark.parametrize("support,longest,keep,seed", [(3, 5, 1.0, 1), (6, 4, 0.8, 2)])
def test_phrases_match_brute_force(spark, monkeypatch, support, longest, keep, seed):
    """Many small shards, so that local supports above one, silent shards and second counts all occur."""
    rng = random.Random(seed)
    text = lambda: "".join(rng.choice("Ab ab cd É e f gg ~ a.b".split(" ")) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ", "]) for _ in range(rng.randrange(40)))
    rows = [(rng.choice(["en", "en", "en", "fr", None]), text()) for _ in range(300)] + [("en", "a b c d e f a b c d e")] * 9 + [("xx", None), ("xx", "")]
    for name, value in (("LEAST", 500), ("AT_ONCE", 200), ("SHARDS", 8), ("WINDOW", 64)):
        monkeypatch.setattr(phrases, name, value)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    assert phrases.shards(docs).count() > 8
    got = phrases.collocations(docs, support=support, longest=longest, top=15, keep=keep)
    assert rows_of(got) == slow_phrases(rows, support, longest, 15, round(keep * 100))


def test_phrases_special_cases(odd_docs, no_docs):
    rows = [(r.lang, r.text) for r in odd_docs.collect()]
    assert rows_of(phrases.collocations(odd_docs, support=2)) == slow_phrases(rows, 2, 5, 2000)
    assert phrases.collocations(no_docs).collect() == []


def test_map_of_phrases_holds_none_back(spark):
    hashes = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 5000)
    bits = phrases.bitmap(spark, spark.createDataFrame([(int(x),) for x in hashes], "h long")).value
    assert phrases.known(bits, hashes.view(np.uint64)).all()
    assert phrases.known(bits, np.arange(100_000, dtype=np.uint64) * phrases.STEP).mean() < 0.01


def test_scores_beyond_64_bits(spark):
    big = 10**12
    found = spark.createDataFrame([("en", "a", 1, 3 * big), ("en", "b", 1, 2 * big), ("en", "a b", 2, big)], "lang string, phrase string, k int, n long")
    row = phrases.scored(found, spark.createDataFrame([("en", 9 * 10**15)], "lang string, n_words long")).first()
    assert (row.score, row.l, row.r) == (1000 * big * 9 * 10**15 // (6 * big * big), 3 * big, 2 * big)


def test_workers_give_freed_memory_back():
    import numpy as np

    from marquee.llm import common

    def held():
        return sum(int(x.split()[1]) for x in open("/proc/self/smaps_rollup") if x.startswith("Pss_Anon")) >> 10

    before = held()
    freed = [np.ones(8_000) for _ in range(2_000)]  # 64 kB each, below what the C library maps by itself
    last = freed[::100]
    del freed
    kept = held()
    common.give_back()
    assert len(last) == 20 and kept - before > 60 and held() - before < 40
