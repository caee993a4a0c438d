import base64
import hashlib
import math
import random
import re
import time
import uuid

import numpy as np
import pytest

from terraloom.llm import html_text, warc_chunks
from terraloom.llm._shared import shared_dir
from terraloom.llm.html_text import FEW, SHARE, extract, main_text, smoothed
from terraloom.llm.warc_chunks import read, records, write

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href=/>Home</a></ul></nav><div class="ad">Buy</div><div class="cookie-notice">We use cookies</div>
<article><h1>Title &amp; more</h1><p>First   paragraph\nwith <b>bold.<br><p>Sh.</p><form><input>Send</form><p>Last one &eacute;.</p>
<section class="comments"><article class="comment"><p>Nice!</p></article></section><ol class="commentlist"><li>Me too</ol></article>
<aside><p>Related things</p></aside><footer>&copy; x</footer>"""


def test_article_without_its_surroundings():
    assert main_text(PAGE) == "Title & more\nFirst paragraph with bold.\nSh.\nLast one é."


def test_page_without_article_element():
    body = "<p>" + "words of the story " * 20 + "</p>"
    page = f"<body class='has-sidebar'><div id=menu><a href=a>a</a></div><div id=content>{body * 3}<p>End.</p></div><div class=sidebar><p>{'side ' * 80}</p></div>"
    assert main_text(page).split("\n")[-1] == "End." and "side" not in main_text(page) and main_text(page).count("story") == 60


def test_nothing_unmarked_is_left_out():
    story = [f"Paragraph {k} tells, in a good many words, what came next in the long story." for k in range(20)]
    body = "".join(f"<p>{x}</p>" for x in story)
    around = f"<html><body><div id=menu><a href=a>Home</a></div><div><a href=b>All the pages</a></div><div id=content><h1>Title</h1><p>lead</p><div class=text>{body}</div><p>closing</p></div></body></html>"
    assert main_text(around).split("\n") == ["Title", "lead", *story, "closing"]
    two = f"<body><div class=sidebar>Side</div><main><h1>Both</h1><article>{body}</article><article><p>The second one</p></article></main></body>"
    assert main_text(two).split("\n") == ["Both", *story, "The second one"]
    for name in ("content-with-sidebar", "layout-no-sidebar", "page-has-ads", "widget"):
        assert main_text(f"<body><div class='{name}'>{body}</div></body>").split("\n") == story
    assert main_text(f"<body><div>{body}<p><a href=c>See the source</a></p></div><div class=comments>{body * 2}</div></body>").split("\n") == [*story, "See the source"]


def test_defined_cases():
    for page, text in [(None, ""), ("", ""), ("<p></p>", ""), ("plain", "plain"), ("<![foo bar", ""), ("<![foo> bar", "<![foo> bar"), ("<p>a<p>b", "a\nb"), ("<div><p>cut off <b", "cut off"), ("<p>&#128512;&nope;</p>", "\U0001f600&nope;")]:
        assert main_text(page) == text
    assert main_text("<p>" + "x" * 2_000_000) == "x" * 2_000_000
    assert abs(smoothed(__import__("numpy").full(7, 3.0)) - 3).max() < 1e-12


def test_extract(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (None, None, None, "t")], "page_id long, url string, html string, text string")
    got = extract(pages).collect()
    assert sorted((r.page_id or -1, r.n_chars, len(r.text)) for r in got) == [(-1, 0, 0), (1, 55, 55), (1, 55, 55)]
    assert extract(pages.limit(0)).count() == 0


def warc_bytes(chunks):
    rows = sorted(chunks.collect(), key=lambda r: (r.archive, r.record_no, r.chunk_no))
    return b"".join(bytes(r.data) for r in rows)


def parsed(data):
    """Records of a WARC file, read by its own rules."""
    while data:
        head, _, data = data.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        assert lines[0] == "WARC/1.1"
        fields = dict(x.split(": ", 1) for x in lines[1:])
        n = int(fields["Content-Length"])
        yield fields, data[:n].partition(b"\r\n\r\n")[2]
        assert data[n : n + 4] == b"\r\n\r\n"
        data = data[n + 4 :]


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_round_trip(spark, monkeypatch, broadcast):
    monkeypatch.setattr(warc_chunks, "BROADCAST_ROWS", broadcast)
    big = "0123456789é\r\n\r\n" * 400
    rows = [(1, "http://a/ü b\r\nx", big, 0), (2, None, big, 0), (3, "u", "small", 0), (4, "u", "small", 0), (5, "u", None, 0), (None, "u", big, 0), (6, "u", "y" * 999, 0), (7, "u", "y" * 999, 0), (9, "u", "z" * 1000, 0), (9, "u", "z" * 1000, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, size int")
    for chunk in (64, 1 << 16):
        path = f"{shared_dir(spark)}/warc-test-{uuid.uuid4().hex}"
        write(pages, path, chunk)
        got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.intact) for r in read(spark, path).collect()), key=repr)
        expected = []
        for i, _, html, _ in rows:
            data = (html or "").encode()
            to = 2 if html == big and i != 2 else None
            expected.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if to else "response", to, True))
        assert got == sorted(expected, key=repr)
    found = list(parsed(warc_bytes(records(pages.coalesce(1), 64))))
    assert len(found) == len(rows)
    for fields, payload in found:
        digest = base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()
        assert fields["WARC-Type"] == "revisit" and payload == b"" or hashlib.sha1(payload).hexdigest() == digest
    assert records(pages.limit(0)).count() == 0


def plain_main_text(html):
    """The same decisions for well-formed pages of div, p, h1, a, nav and article, by loops over a list of blocks."""
    stack, parent, kinds, blocks, text, tags, links = [0], [-1], [""], [], "", 0, 0
    for token in re.findall(r"<[^>]+>|[^<]+", html):
        if token[0] != "<":
            text += token
            links += len(token.strip()) if any(kinds[k] == "a" for k in stack) else 0
            continue
        name = re.match(r"</?(\w+)", token)[1]
        if name != "a" and text.strip():
            blocks.append((" ".join(text.split()), max(tags, 1), links, [k for k in stack if kinds[k] != "p"]))
            tags = 0
        if name != "a":
            text, links = "", 0
        tags += 1
        if token[1] == "/":
            stack.pop()
        else:
            parent.append(stack[-1])
            kinds.append("p" if name in ("p", "h1") else "mark" if name == "nav" or 'class="ad"' in token else name)
            stack.append(len(kinds) - 1)
    if not blocks:
        return ""
    framed = {p for k, kind in enumerate(kinds) if kind == "article" for p in chain(k, parent)[1:]}
    marks = [next((k for k in path if kinds[k] == "mark" and k not in framed), 0) for *_, path in blocks]
    ratio = [0.0] * len(blocks)
    for i in range(len(blocks)):
        near = [j for j in range(max(0, i - 3), min(len(blocks), i + 4)) if len({marks[k] for k in range(min(i, j), max(i, j) + 1)}) == 1]
        weights = [math.exp(-0.5 * (i - j) ** 2) for j in near]
        ratio[i] = sum(w * len(blocks[j][0]) / blocks[j][1] for w, j in zip(weights, near)) / sum(weights)
    mean = sum(ratio) / len(ratio)
    bar = math.sqrt(sum((r - mean) ** 2 for r in ratio) / len(ratio))
    size = {m: sum(len(b[0]) for b, x in zip(blocks, marks) if x == m) for m in {0, *marks}}
    weak = {m for m in size if m and size[m] < FEW and size[0] < FEW}
    mass = [sum(r for r, b, m in zip(ratio, blocks, marks) if r >= bar and m not in weak and k in b[3]) for k in range(len(kinds))]
    core = 0
    while True:
        inner = [k for k in range(1, len(kinds)) if node_parent(k, parent, kinds) == core and kinds[k] not in ("p", "a") and mass[k] > 0]
        best = max(inner, key=lambda k: mass[k], default=None)
        if best is None or mass[best] < SHARE * mass[core]:
            break
        core = best
    path = chain(core, parent)
    value = {m: sum(r * len(b[0]) for r, b, x in zip(ratio, blocks, marks) if x == m) / max(1, size[m]) for m in size}
    gone = {k for k, kind in enumerate(kinds) if kind == "mark" and k not in framed and k not in path}
    if kinds[core] in ("", "body", "html") and size[0] >= FEW:
        gone -= {m for m in value if m and value[m] >= value[0]}
    blocks = [b for b in blocks if not gone & set(b[3])]
    loose = lambda b: 2 * b[2] <= len(b[0])
    weight = [sum(len(b[0]) for b in blocks if k in b[3] and loose(b)) for k in range(len(kinds))]
    region = core
    for k in path:
        if weight[k] > weight[region]:
            region = k
        if kinds[k] == "article":
            break
    own = {k for k, kind in enumerate(kinds) if kind == "article"} | ({core} if kinds[core] not in ("", "body", "html") else set())
    return "\n".join(b[0] for b in blocks if region in b[3] and (own & set(b[3]) or loose(b)))


def chain(k, parent):
    out = [k]
    while k:
        out.append(k := parent[k])
    return out


def node_parent(k, parent, kinds):
    k = parent[k]
    while kinds[k] in ("p", "a"):
        k = parent[k]
    return k


def test_against_a_plain_version():
    rng = random.Random(3)
    say = lambda n: " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 8))) for _ in range(n))

    def tree(depth, article):
        out = ""
        for _ in range(rng.randint(1, 4)):
            kind = rng.random()
            if kind < 0.55 or not depth:
                out += f"<p>{say(rng.choice((1, 3, 10, 60)))}</p>" if rng.random() < 0.8 else f"<p><a>{say(2)}</a>{say(1)}</p>"
            elif kind < 0.7:
                out += f"<nav><p><a>{say(2)}</a></p><p>{say(rng.choice((1, 40)))}</p></nav>"
            elif kind < 0.8:
                out += f'<div class="ad"><p>{say(rng.choice((5, 60)))}</p>{tree(depth - 1, article)}</div>'
            else:
                out += f"<div>{tree(depth - 1, article)}</div>"
        return out

    for _ in range(400):
        body = tree(3, False)
        page = f"<body>{body}<article><h1>{say(3)}</h1>{tree(2, True)}</article>{tree(1, False)}</body>" if rng.random() < 0.5 else f"<body>{body}</body>"
        assert main_text(page) == plain_main_text(page), page


def test_ratios_decide(monkeypatch):
    rng = np.random.default_rng(4)
    story = "".join(f"<p>{'some words of it ' * (2 + k % 5 * 8)}</p>" for k in range(6))
    page = f"<body><nav><ul><li><a>one</a><li><a>two</a><li><a>six</a></ul></nav><div class=ad>Buy this</div><article><h1>Title</h1>{story}</article><footer>All rights reserved</footer>"
    right = main_text(page)
    assert right.startswith("Title") and "Buy" not in right and "rights" not in right and "two" not in right
    monkeypatch.setattr(html_text, "smoothed", lambda r, sigma: rng.random(len(r)))
    assert sum(main_text(page) != right for _ in range(100)) > 50


def test_linear_in_unclosed_and_unopened_tags():
    for opened, closed in (("<b>", "</i>"), ("<i><b>", "</i>"), ("<b><div>", "</b>"), ("<p>", "</div>"), ("<td>", "</b>")):
        began = time.process_time()
        main_text(opened * 30_000 + "x" + closed * 30_000)
        assert time.process_time() - began < 10


def test_pieces_do_not_matter(monkeypatch):
    whole = [main_text(PAGE * k) for k in (1, 3)]
    for size in (1, 7, 64):
        monkeypatch.setattr(html_text, "_PIECE", size)
        assert [main_text(PAGE * k) for k in (1, 3)] == whole
