"""Main text of pages: markup by hand, and template removal against a plain count."""

import random
from collections import defaultdict

import pytest

from groundspark.llm.common import Scratch
from groundspark.llm.extraction import FEW, MANY, SHARE_OF_PAGES, SMALL_HOST, Page, content_key, extract, host_of, main_text, op12_html_extraction


@pytest.mark.parametrize(
    "html,wanted",
    [
        ("", ""), ("just words", "just words"), ("<p>a<p>b", "a\n\nb"), ("<p>  a\n\t&nbsp;b  </p>", "a b"), ("<p>a &amp; b &#233; &copy &am", "a & b é © &am"), ("<p>1 < 2 <3</p>", "1 < 2 <3"),
        ("<article><h1>T</h1><p>a<br>b</p></article><footer>f</footer>", "T\n\na b"), ("<nav><ul><li>m</ul></nav><p>text", "text"), ("<script>var t='</p><p>x';</script><style>p{}</style><p>t", "t"),
        ("<body><div class='ad'>buy</div><div id='mainContent'><p>text</p></div><div class=\"cookie-notice\">ok?</div>", "text"), ("<div class=siteFooter>f</div><p>t", "t"),
        ("<main><h1>H</h1><p>t</p><aside>s</aside></main><p>outside</p>", "H\n\nt"), ("<article><header><h1>T</h1></header><p>t</p><footer>by me</footer></article>", "T\n\nt"), ("<header><h1>site</h1></header><p>t", "t"),
        ("<article><p>t</p><section id='comments'><article class='comment'><p>first!</p></article></section></article>", "t"), ("<article class=comment>c</article><article>t</article>", "t"),
        ("<form action=x><input name=q><main><p>t</p></main></form>", "t"), ("<form><label>Name</label><input></form><p>t</p>", "t"), ("<p>t<select><option>1<option>2</select></p>", "t"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a b\n\nc"), ("<ul><li>one<li>two<ul><li>in</ul></ul>", "one\n\ntwo\n\nin"), ("<p>a<b>b</p><p>c</b>d</p>", "ab\n\ncd"), ("<p><b>x<br><p>y</p>", "x\n\ny"),
        ("<!-- <p>no</p> --><p>t<!-- no", "t"), ("<!DOCTYPE html><?xml x?><p>t", "t"), ("<p hidden>no</p><p style='display: none'>no</p><p>t", "t"), ("<p>t</p><p>cut <a href='x", "t\n\ncut"), ("<p>t</p><scr", "t"),
        ("<div class='sidebar'><p>s</p><article><p>t</p></article>", "t"), ("<aside><article>card</article></aside><article>t</article>", "t"), ("<textarea><p>x</textarea><title>T</title><p>t", "t"), ("<a href='<>'>t</a>", "t"),
        ("<ul><li><a>a</a><li><a>b</a><li><a>c</a></ul><p>t</p>", "t"), ("<article><ul><li><a>a</a><li><a>b</a><li><a>c</a></ul></article>", "a\n\nb\n\nc"), ("<p>x</div>y</p>", "xy"), ("<pre>a\n  b</pre>", "a b"), ("<p class='heading post-header'>t</p>", ""),
    ],
)
def test_markup(html, wanted):
    assert Page(html).text(set())[0] == wanted


def test_hosts_and_long_pages():
    assert [host_of(u) for u in (None, "no", "http://A.b:80/x?y", "HTTPS://É.Com#z", "x://?q")] == ["", "", "a.b:80", "É.com".replace("É", "É"), ""]
    deep = "<div>" * 3000 + "word " * 200_000 + "<b>" * 3000
    assert Page(deep).text(set())[0].count("word") == 200_000
    assert Page("<a x=\"" * 5000 + "text").text(set())[0] == ""


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))


def made():
    rng = random.Random(4)
    pages = []
    legal, box = words(rng, 12), words(rng, 8)
    copied = "".join(f"<div class='t'><p>{words(rng, 30)}</p></div>" for _ in range(4))
    shared = words(rng, 40)
    for k in range(60):  # a host whose template has no telling names
        article = "".join(f"<div class='t'><p>{words(rng, 30)}</p></div>" for _ in range(3))
        pages.append((f"http://big.example/{k}", f"<body><div class='x1'><p>{legal}</p><p>{k % 2}</p></div><div class='c'>{article}<div class='x2'>{box}</div><p>{shared}</p></div></body>"))
    for k in range(50):  # copies of one article, each beside another short line
        pages.append((f"http://big.example/copy{k}", f"<body><div class='c'>{copied}</div><p>{words(rng, 3)}</p></body>"))
    for k in range(5):
        pages.append((f"http://small.example/{k}", f"<div class='z'>{legal} small</div><div class='c'><p>{words(rng, 40)}</p></div>"))
    pages += [(None, None), ("http://big.example/none", ""), ("http://big.example/only", f"<div class='x2'>{box}</div>"), ("odd", f"<div class='x2'>{box}</div><p>{words(rng, 20)}</p>")]
    return [(k, u, h, "other") for k, (u, h) in enumerate(pages)] + [(0, *pages[0], "again")]


def plain(rows):
    pages = [Page(h or "", host_of(u)) for _, u, h, _ in rows]
    contents, hosts, of_host = defaultdict(lambda: defaultdict(int)), {}, defaultdict(int)
    for (_, u, _, _), page in zip(rows, pages):
        of_host[host_of(u)] += 1
        key = int(content_key([[t for t, _, chrome in page.blocks if not chrome]])[0])
        whole = sum(len(b[0]) for b in page.blocks)
        for s in {s for s, _, _, n in page.subtrees if 2 * n < whole}:
            contents[s][key] += 1
            hosts[s] = host_of(u)
    gone = set()
    for s, found in contents.items():
        n, total, size = len(found), sum(found.values()), of_host[hosts[s]]
        if (n >= MANY and n * SHARE_OF_PAGES >= total) or (n >= FEW and size <= SMALL_HOST and 2 * total >= size):
            gone.add(s)
    return sorted((k, extra, *page.text(gone)) for (k, _, _, extra), page in zip(rows, pages))


def test_templates_go_and_copies_stay(spark):
    rows = made()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string").withColumnRenamed("text", "removed").repartition(4)
    wanted = plain(rows)
    for most in (1 << 20, 0):
        found = extract(pages, Scratch(spark, "test"), text="main", removed="n", most_sent=most)
        assert found.columns == ["page_id", "url", "removed", "main", "n"]
        assert sorted((r["page_id"], r["removed"], r["main"], r["n"]) for r in found.collect()) == wanted
    by_id = {k: (t, n) for k, _, t, n in wanted}
    first, copy = by_id[0][0].split("\n\n"), by_id[60][0].split("\n\n")
    assert len(first) == 4 and by_id[0][1] == 3  # three paragraphs and the shared passage; the two paragraphs of x1 and the box go
    assert len(copy) == 5 and by_id[60][1] == 0  # a whole copied article
    assert by_id[110][1] == 1 and by_id[112 + 3] == ("", 0) and by_id[117] == ("", 1) and by_id[118][1] == 0
    clash = extract(pages.withColumnsRenamed({"removed": "text"}), Scratch(spark, "test"))
    assert clash.columns == ["page_id", "url", "text", "n_template_blocks"] and clash.count() == len(rows)


def test_query_on_a_table(spark, tmp_path):
    rng = random.Random(9)
    rows, wanted = [], []
    for k in range(30):
        parts = [words(rng, 6), *[words(rng, 20) for _ in range(k % 4 + 1)]]
        html = f"<html><head><title>x</title></head><body><nav><a href='/'>{words(rng, 1)}</a></nav><div class='ad'>{words(rng, 5)}</div><article><h1>{parts[0]}</h1>{''.join(f'<p>{p}</p>' for p in parts[1:])}</article><footer>&copy; me</footer>"
        rows.append((k, f"https://h{k % 2}.example/{k}", html))
        wanted.append((k, rows[-1][1], "\n\n".join(parts), len("\n\n".join(parts))))
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = op12_html_extraction(spark, str(tmp_path))
    assert sorted(tuple(r)[:4] for r in found.collect()) == wanted
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/none/pages.parquet")
    assert op12_html_extraction(spark, f"{tmp_path}/none").collect() == [] and main_text([], [], [], []) == ("", 0)
