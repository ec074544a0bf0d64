"""Quality and WARC derivatives of whole tables against plain computations that share no code with the operators."""

import base64
import hashlib
import json
import math
import re
from collections import defaultdict
from html.parser import HTMLParser
from urllib.parse import urljoin

import pytest

from duebook.llm import quality
from duebook.llm.queries import op3_quality, op9_warc_derivatives

SYMBOLS = "!#$%&*+<=>@[]\\^_`{|}~"


def described(text, lexicon):
    """The eleven features of a text, counted character by character."""
    data = text.encode()
    size = max(1, len(data))
    symbols = sum(b < 128 and chr(b) in SYMBOLS for b in data) / size
    capitals, small, digits = (sum(a <= b <= z for b in data) for a, z in ((65, 90), (97, 122), (48, 57)))
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    distinct = len(set(words))
    letters, word = set(), ""
    for c in text.lower() + " ":
        if c.isalpha():
            word += c
        else:
            letters.add(word)
            word = ""
    hits, n = len(letters & lexicon), max(1, len(words))
    repeats = 1 - distinct / n if words else 0.0
    return [symbols, symbols ** 0.5, capitals / max(1, capitals + small), digits / size, repeats,
            max(0.0, repeats - 0.09 * max(0.0, math.log(n) - 3) - 0.2), 1 - len(set(lines)) / max(1, len(lines)), math.log(1 + len(words)),
            math.log(1 + size / n), math.log(1 + hits), min(1.0, 5 * hits / max(1, distinct))]


def worth(groups):
    """Rows that a prior is worth, from (rate, mean, rows) of each group."""
    seen = sum((r - m) ** 2 for r, m, _ in groups) / len(groups)
    chance = sum(m * (1 - m) / n for _, m, n in groups) / len(groups)
    whole = sum(m * (1 - m) for _, m, _ in groups) / len(groups)
    return min(max(whole / max(seen - chance, 1e-6) - 1, 1.0), 10_000.0)


def test_quality_of_the_whole_table(spark, folder):
    documents, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(documents.select("doc_id", "text", "source", "lang"), labels)
    rows = documents.select("doc_id", "text", "source", "lang").collect()
    evidence = {}
    for r in rows:
        x = described(r["text"] or "", model.lexicon)
        z = model.weights[0] + sum(w * (v - m) / s for w, v, m, s in zip(model.weights[1:], x, model.mean, model.scale))
        evidence[r["doc_id"]] = min(12, max(-12, z - model.base))
    share = {d: 1 / (1 + math.exp(-(e + model.base))) for d, e in evidence.items()}
    path, host = defaultdict(list), defaultdict(list)
    for r in rows:
        path[r["source"], r["lang"]].append(share[r["doc_id"]])
        host[r["source"]].append(share[r["doc_id"]])
    mean = (sum(share.values()) + 1) / (len(share) + 2)
    host_worth = worth([(sum(v) / len(v), mean, len(v)) for v in host.values()])
    posterior = {h: (sum(v) + host_worth * mean) / (len(v) + host_worth) for h, v in host.items()}
    path_worth = worth([(sum(v) / len(v), posterior[h], len(v)) for (h, _), v in path.items()])
    found = {r["doc_id"]: r for r in op3_quality(spark, folder).collect()}
    assert len(found) == len(rows)
    for r in rows:
        d, h, p = r["doc_id"], host[r["source"]], path[r["source"], r["lang"]]
        of_host = (sum(h) - share[d] + host_worth * mean) / (len(h) - 1 + host_worth)
        of_path = (sum(p) - share[d] + path_worth * of_host) / (len(p) - 1 + path_worth)
        prior = min(1 - 1e-4, max(1e-4, of_path))
        score = 1 / (1 + math.exp(-(math.log(prior / (1 - prior)) + evidence[d])))
        got = found[d]
        assert (got["quality_evidence"], got["quality_host"], got["quality_path"], got["quality_score"]) == pytest.approx(
            (evidence[d], of_host, of_path, score), rel=1e-6, abs=1e-9)
        assert got["quality_keep"] == (got["quality_score"] >= 0.5)


BLOCK = set("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav "
            "ol option p pre section table tbody td tfoot th thead title tr ul".split())
SILENT = {"script", "style", "noscript", "template"}


class Page(HTMLParser):
    """Title, links and text of a page by the standard parser."""

    def __init__(self, uri):
        super().__init__(convert_charrefs=True)
        self.base, self.out, self.links, self.title, self.silent, self.in_title = uri, [], [], None, 0, False

    def handle_starttag(self, tag, attributes):
        got = {k: v or "" for k, v in reversed(attributes)}
        if tag in SILENT:
            self.silent += 1
        elif not self.silent:
            self.out += ["\n"] if tag in BLOCK else []
            self.in_title |= tag == "title" and self.title is None
            if tag == "base" and "href" in got:
                self.base = got["href"]
            elif tag in ("a", "link", "img", "area", "iframe") and ("href" in got or "src" in got):
                self.links.append(urljoin(self.base, got.get("href") or got.get("src") or ""))

    def handle_startendtag(self, tag, attributes):
        if tag not in SILENT:
            self.handle_starttag(tag, attributes)

    def handle_endtag(self, tag):
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif not self.silent:
            self.out += ["\n"] if tag in BLOCK else []
            self.in_title &= tag != "title"

    def handle_data(self, data):
        if not self.silent:
            self.out.append(data.replace("\n", " "))
            if self.in_title:
                self.title = (self.title or "") + data

    def text(self):
        lines = (re.sub(r"\s+", " ", line).strip() for line in "".join(self.out).split("\n"))
        return "\n".join(line for line in lines if line)


def sha1(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_derivatives_of_the_whole_table(spark, folder):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    records = op9_warc_derivatives(spark, folder).collect()
    assert len(records) == 2 * len(pages)
    by = {(r["page_id"], r["type"]): r for r in records}
    ids = [r["record_id"] for r in records]
    assert len(set(ids)) == len(ids) and all(re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", i) for i in ids)
    for page_id, page in pages.items():
        own = Page(page["url"] or "")
        own.feed(page["html"] or "")
        own.close()
        meta, text = by[page_id, "metadata"], by[page_id, "conversion"]
        assert text["content"] == own.text()
        for r in (meta, text):
            assert r["payload_digest"] == sha1((page["html"] or "").encode()) and r["block_digest"] == sha1(r["content"].encode())
            assert r["n_bytes"] == len(r["content"].encode()) and r["uri"] == (page["url"] or "")
        assert meta["refers_to"] == text["refers_to"] and text["concurrent_to"] == meta["record_id"] and meta["concurrent_to"] is None
        http = json.loads(meta["content"])["Envelope"]["Payload-Metadata"]["HTTP-Response-Metadata"]
        assert [x["url"] for x in http["HTML-Metadata"]["Links"]] == own.links and meta["n_links"] == len(own.links)
        assert (http["HTML-Metadata"]["Head"]["Title"] or "") == re.sub(r"\s+", " ", own.title or "").strip()
        assert http["Entity-Length"] == str(len((page["html"] or "").encode()))
