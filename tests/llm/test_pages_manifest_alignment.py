"""Page texts, the Merkle manifest and tokenizer alignment against plain versions."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from logquill.llm import alignment, html_text, manifest, queries


def extract(source, winners=()):
    return html_text.Page(source).extract(list(winners))


def test_pages_of_the_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    found = {r["page_id"]: r for r in queries.op11_html_text(spark, sf).collect()}
    assert len(found) == len(pages)
    for r in pages:
        body = re.search("<article>(.*)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html_text.html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("<(?:p|/p|h1|/h1)>", body)]
        assert found[r["page_id"]]["text"] == "\n".join(filter(None, blocks))
        assert found[r["page_id"]]["n_chars"] == len(found[r["page_id"]]["text"]) and found[r["page_id"]]["url"] == r["url"]


ARTICLE = "<h1>A title</h1><p>First paragraph, with some words &amp; an <a href=x>inline link</a>.<p>Second   one\n has <b>bold</b>text, and more of it.</p><ul><li>One item<li>Another</ul>"
TEXT = "A title\nFirst paragraph, with some words & an inline link.\nSecond one has boldtext, and more of it.\nOne item\nAnother"
AROUND = [
    "<nav><a href=/>Home</a> <a href=/a>All of the long menu entries, one by one</a></nav>", "<header><h1>Site name</h1><p>The site's motto, which is long and has commas, too.</p></header>",
    "<aside><p>A sidebar with a paragraph of text, long enough to count as one.</p></aside>", "<footer><p>Copyright, imprint, and a long text about rights, which are reserved.</p></footer>",
    "<div class='cookie-notice'><p>We use cookies, and we tell so in a long sentence.</p></div>", "<form><label>Search</label><input name=q><button>Go, find what is looked for</button></form>",
    "<section id=comments><div class=comment><p>A reader says something, at some length, that is no part of it.</p></div></section>", "<div style='display: none'>Hidden text, quite long, of no use to readers of it.</div>",
    "<script>document.write('<p>No text, though it is long enough for a paragraph</p>')</script><style>p > b{}</style><!-- <p>gone</p> -->",
]


@pytest.mark.parametrize("holder", ["<article>{}</article>", "<main><div class=post-12>{}</div></main>", "<div class='entry content'><div>{}</div></div>", "<table><tr><td>{}</td></tr></table>"])
def test_what_is_around_an_article_is_left_out(holder):
    for k, x in enumerate(AROUND):
        assert extract(f"<!DOCTYPE html><html><head><title>T &lt;</title></head><body>{x}{holder.format(ARTICLE)}{AROUND[k - 1]}</body></html>") == TEXT
        if k != 1:  # headings in an article's own header are kept
            assert extract(holder.format(ARTICLE + x)) == TEXT


def test_broken_and_odd_pages():
    assert extract("") == extract("<") == "" or extract("<") == "<"
    assert extract("just text &amp; more") == "just text & more"
    assert extract("<p>Unclosed <b>bold <p>next &copy &#x41;&xnone;") == "Unclosed bold\nnext © A&xnone;"
    assert extract("<article><p>a</div></span></p>b</article>c") == "a\nb"
    assert extract('<article title="a > b"><p class=x=">one</p></article>') == "one"
    assert extract("<script>never closed <p>x</p>") == ""
    assert extract("<article><header><h1>Kept</h1><p>dropped</p></header><p>Text</p></article>") == "Kept\nText"
    assert extract("<article><pre> a\n  b </pre>tail<br>end</article>") == "a b\ntail end"
    assert len(extract("<div>" * 20_000 + "<p>deep</p>" + "</div>" * 20_000)) == 4
    long = "<article>" + "<p>word and word &amp; word</p>" * 50_000 + "</article>"
    assert extract(long) == "\n".join(["word and word & word"] * 50_000)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/=\"'! -abp&;#1\n", max_size=80))
def test_any_text_is_a_page(source):
    extract(source)


def test_hosts_agree_on_a_path(spark):
    good = "<div class='story s-{0}'><p>Text of page {0}, which is long enough to be told, and goes on for a while.</p></div>"
    short = "<div class='story s-99'><p>Brief.</p></div><div class=links><p>Something else that is longer than the story, on this page alone, for once.</p></div>"
    rows = [(k, f"https://u@Host.example:80/{k}", good.format(k)) for k in range(30)] + [(99, "http://host.example/x", short), (100, "http://other.example/", short), (101, None, short), (102, "http://host.example/y", None), (None, "http://host.example/z", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS Winners", "3 AS text")
    found = {r["page_id"]: r["text"] for r in html_text.extract_pages(pages).collect()}
    assert found[99] == "Brief." and found[5].startswith("Text of page 5,") and found[100] == found[101] == "Something else that is longer than the story, on this page alone, for once."
    assert found[102] == found[None] == "" and len(found) == len(rows)
    paths = {(r["host"], r["path"]): r["votes"] for r in html_text.host_paths(pages).collect()}
    assert paths == {("host.example", "div.s-#.story"): 30, ("host.example", "div.links"): 1, ("other.example", "div.links"): 1}
    assert html_text.extract_pages(pages.limit(0)).collect() == []


def H(*x):  # noqa: N802
    return hashlib.sha256("".join(x).encode()).hexdigest()


def plain_manifest(rows):
    """By plain lists: (doc_id, leaf, subroot, root, proof, folded root) of rows."""

    def told(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, text):
        return H(*(told(r[c]) for c in ("doc_id", "source", "lang", "n_chars")), told(text))

    def grow(level):
        """The root and, of each node, its runs with its place in them."""
        paths = [[] for _ in level]
        at = list(range(len(level)))
        while len(level) > 1:
            runs = [level[k : k + 8] for k in range(0, len(level), 8)]
            for i, p in enumerate(at):
                paths[i].append((runs[p // 8], p % 8))
            at = [p // 8 for p in at]
            level = [H(*x) for x in runs]
        return level[0], paths

    langs = defaultdict(list)
    for r in rows:
        langs[r["lang"]].append((r["doc_id"] is not None, r["doc_id"], leaf(r, r["text"]), r))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for x in order:
        langs[x].sort(key=lambda y: (y[0], y[1] or 0, y[2]))
        trees[x] = grow([y[2] for y in langs[x]])
    root, tops = grow([trees[x][0] for x in order])
    for x, top in zip(order, tops, strict=True):
        for (_, doc_id, own, r), path in zip(langs[x], trees[x][1], strict=True):
            tampered = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0 and r["text"] is not None
            folded = leaf(r, re.sub("[A-Z]", lambda m: m[0].lower(), r["text"])) if tampered else own
            proof = ""
            for run, at in path + top:
                proof += "".join(run[:at] + run[at + 1 :])
                folded = H(*run[:at], folded, *run[at + 1 :])
            yield doc_id, own, trees[x][0], root, H(proof), folded, folded == root


def told_rows(df):
    return Counter(tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())


def test_manifest_of_the_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    found = told_rows(queries.op12_merkle_manifest(spark, sf))
    assert found == Counter(plain_manifest(rows)) and {x[-1] for x in found} == {True, False}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    columns = "doc_id, leaf, subroot, root, proof_sha256, folded_root, verified"
    assert Counter(con.execute(f"SELECT {columns} FROM ({queries.ORACLE_SQL['op12_merkle_manifest']})").fetchall()) == found


@pytest.mark.parametrize("sizes", [[1], [0, 8], [9, 1, 2], [65, 600], [1] * 9 + [513]])
def test_manifest_of_groups_of_any_size(spark, sizes):
    rows = [(f"l{k:02}" if k else None, i * 7 % 5000, f"Text {i} É" if i % 5 else None, 3, None) for k, n in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(rows, "lang string, doc_id long, text string, n_chars long, source string").selectExpr("*", "1 AS Rank", "2 AS hash").repartition(3)
    assert told_rows(manifest.manifest(docs)) == Counter(plain_manifest(docs.collect()))


def test_manifest_of_odd_rows(spark, odd_docs, no_docs):
    assert told_rows(manifest.manifest(odd_docs)) == Counter(plain_manifest(odd_docs.collect()))
    assert manifest.manifest(no_docs).collect() == []


def test_manifest_of_several_blocks_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(manifest, "DIGITS", 1)
    docs = spark.range(700).selectExpr("id AS doc_id", "concat('Text ', id) AS text", "if(id % 3 = 0, 'a', concat('x', id % 20)) AS lang", "id AS n_chars", "'s' AS source")
    assert told_rows(manifest.manifest(docs)) == Counter(plain_manifest(docs.collect()))


A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
A_BYTES, B_BYTES = (alignment.aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")).bytes[k] for k in (0, 1))


def plain_alignment(text):
    """(ids of A, ids of B, groups) of a whole text, encoded at once, by sets of ends."""
    if not text:
        return [], [], []
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    own = [[A_BYTES[i] for i in a], [B_BYTES[i] for i in b]]
    if any(b"".join(x) != (" " + text).encode() for x in own):
        return [], [], []
    ends = [[0] for _ in own]
    for x, e in zip(own, ends, strict=True):
        for t in x:
            e.append(e[-1] + len(t))
    cuts, groups, at = set(ends[0]) & set(ends[1]) - {0}, [], [0, 0]
    for cut in sorted(cuts):
        to = [e.index(cut, k) for e, k in zip(ends, at, strict=True)]
        groups.append((a[at[0] : to[0]], b[at[1] : to[1]]))
        at = to
    return a, b, groups


def check_alignment(docs, rows):
    texts = docs.select("doc_id", "text").collect()
    plain = [(r["doc_id"], *plain_alignment(r["text"])) for r in texts]
    count = Counter((x[-1], y[-1]) for *_, groups in plain for x, y in groups)
    most = defaultdict(int)
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    expected = Counter()
    for doc_id, a, b, groups in plain:
        links = [(x[-1], y[-1]) for x, y in groups]
        told = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        expected[doc_id, len(a), len(b), len(groups), len(links), sum(count[k] == most[k[1]] for k in links), sum(count[k] for k in links), H(told) if a else ""] += 1
    assert Counter(tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in rows) == expected


def test_alignment_of_the_table(spark, sf):
    check_alignment(spark.read.parquet(f"{sf}/documents.parquet"), queries.op13_alignment(spark, sf).collect())


ODD = [" ", "a ", " a", "a  b\n\n c ", "a\n  b", "don't <|endoftext|>x<s> </s><unk> <0x0A>", "▁a b", "é ẛ̣ ﬁ", "日本語 🙂‍", "\x00\x1c\x1f a\x85b c　d", "\t", "=-" * 400, "x" * 3000 + " y"]


def test_alignment_of_odd_rows(spark, odd_docs, no_docs, monkeypatch):
    odd = odd_docs.union(spark.createDataFrame([(100 + k, t, *[None] * 7) for k, t in enumerate(ODD)], odd_docs.schema))
    check_alignment(odd, alignment.align_documents(odd).collect())
    assert alignment.align_documents(no_docs).collect() == []
    monkeypatch.setattr(alignment, "CHUNK_DOCS", 3)
    rows = alignment.align_documents(odd, with_groups=True).collect()
    check_alignment(odd, rows)
    assert all((H(r["groups"]) if r["groups"] else "") == r["groups_sha256"] for r in rows)


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="aA1's d!\n\t \x85 ́é<s>▁日", max_size=60)))
def test_stretches_are_aligned_as_whole_texts(text):
    own = alignment.aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")).align(["", text])[1]
    a, b, groups = plain_alignment(text)
    assert own[:3] == (len(a), len(b), len(groups))
    assert own[3].decode() == ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
    assert Counter(dict(zip(own[4].tolist(), own[5].tolist(), strict=True))) == Counter(x[-1] * alignment.BASE + y[-1] for x, y in groups)


@settings(max_examples=300, deadline=None)
@given(st.sets(st.integers(0, 300)), st.sets(st.integers(0, 300)))
def test_galloping_finds_the_common_ends(a, b):
    x, y = np.array(sorted(a), np.int64), np.array(sorted(b), np.int64)
    i, j = alignment.common_ends(x, y)
    assert x[i].tolist() == y[j].tolist() == sorted(a & b)
