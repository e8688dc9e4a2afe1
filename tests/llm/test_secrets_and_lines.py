"""Secret spans and boilerplate lines against plain computations."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tidemark.llm import line_dedup, secrets

ASSIGN = re.compile(secrets.ASSIGN, re.ASCII)


def plain_base(text):
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def plain_windows(string, window, least):
    spans = []
    for at in range(len(string) - window + 1):
        counts = Counter(string[at : at + window])
        if -sum(c / window * math.log2(c / window) for c in counts.values()) >= least - 1e-9 and not re.search(secrets.PLACEHOLDER, string[at : at + window]):
            if spans and at <= spans[-1][1]:
                spans[-1][1] = at + window
            else:
                spans.append([at, at + window])
    return spans


def plain_all(text):
    base = plain_base(text)
    added = []
    for rank, (kind, pattern, window, least) in enumerate(secrets.CLASSES, 3):
        for m in re.finditer(pattern, text):
            for s, e in plain_windows(m[0], window, least):
                part = m[0][s:e]
                if re.search("[0-9]", part) and re.search("[A-Za-z]", part) and not re.search(secrets.KNOWN_DIGEST, part) and not re.search(secrets.WHOLE_UUID, m[0]):
                    added.append((m.start() + s, rank, m.start() + e, kind))
    return sorted(base + [a for a in added if not any(b[0] <= a[0] and b[2] >= a[2] for b in base)])


def texts():
    random.seed(4)
    hexed = lambda n: "".join(random.choices("0123456789abcdef", k=n))
    mixed = lambda n: "".join(random.choices("ABCDEFGHabcdefghijkl0123456789+/", k=n))
    fixed = [
        None, "", "no secrets", "password=abcdef", "PassWord : 'abc'", "token=token: abcdefgh", "api_key==x apikey=\"" + mixed(30), "secret:=a" * 3,
        "AKIA" + "A1" * 8, "AKIA" + "A" * 15, "AKIAAKIA" + "B" * 20, hexed(23), hexed(24), hexed(60), hexed(40).upper(), mixed(40), mixed(24) + "aaaaaaaaaaaaaaaaaaaaaaaa" + mixed(30),
        "\U0001f600 é token=" + hexed(30) + "\n" + mixed(50), "a" * 200_000 + " " + hexed(32), "123e4567-e89b-42d3-a456-426614174000", "da39a3ee5e6b4b0d3255bfef95601890afd80709",
        "password=EXAMPLE1234 " + mixed(20) + "EXAMPLE" + mixed(20), "Donaudampfschifffahrtsgesellschaftskapitaen" * 3, "k" * 24 + "0123456789abcdef" * 4,
    ]
    parts = ["password=", "token: ", "'", " ", "=", "AKIA", "SECRET", "x", "é", "0af3", "abcdefg9", "Q7", "\n", "api-key", "apikey :"]
    return fixed + ["".join(random.choices(parts, k=random.randint(1, 40))) for _ in range(150)] + [mixed(random.randint(20, 90)) for _ in range(40)]


def test_spans_equal_plain_ones(documents):
    given = texts()
    found = secrets.with_secrets(documents(*given)).select("doc_id", "base_secrets", "secrets", secrets.redacted(F.coalesce("text", F.lit("")), F.col("secrets")).alias("safe")).collect()
    assert len(found) == len(given)
    added = 0
    for r in found:
        text = given[r.doc_id] or ""
        assert [tuple(s) for s in r.base_secrets] == plain_base(text), text[:100]
        assert [tuple(s) for s in r.secrets] == plain_all(text), text[:100]
        added += len(r.secrets) - len(r.base_secrets)
        covered = {k for s in r.secrets for k in range(s.start, s.end)}
        assert r.safe.replace("[SECRET]", "") == "".join(c for k, c in enumerate(text) if k not in covered)
    assert added > 20


def test_allowed_strings_are_not_added(documents):
    ids = {8: 1, 19: 0, 20: 1}  # an access key, a UUID, a digest of nothing (a hex run by the fixed forms)
    found = {r.doc_id: r for r in secrets.with_secrets(documents(*texts())).collect()}
    assert {k: len(found[k].secrets) for k in ids} == ids


def test_a_placeholder_silences_what_it_is_part_of_alone(documents):
    key = "q7Rk2vXz9LmB4tYw8NsD1fHg6JpC3"
    given = [f"path/to/{key}", f"samples/data/{key}", f"{key}/dummy/{key[::-1]}", f"{key[:12]}EXAMPLE{key[12:24]}", "https_//h/" + "A" * 9 + f"/{key}", "x" * 8 + f"={key}"]
    found = {r.doc_id: r.secrets for r in secrets.with_secrets(documents(*given)).collect()}
    for k, text in enumerate(given):
        assert [tuple(s) for s in found[k]] == plain_all(text)
        covered = {at for s in found[k] for at in range(s.start, s.end)}
        whole = [m.start() for part in (key, key[::-1]) for m in re.finditer(re.escape(part), text)]
        assert all(sum(at in covered for at in range(start, start + len(key))) >= len(key) - 6 for start in whole), text
        assert bool(covered) == bool(whole)


def plain_kept(pages):
    lines = {p: [x for x in (" ".join(line.split(" ")).strip(" ") for line in (t or "").split("\n")) if x] for p, _, t in pages}
    lines = {p: [re.sub(" +", " ", x) for x in v] for p, v in lines.items()}
    by_host = defaultdict(list)
    for p, host, _ in pages:
        by_host[host].append(p)
    out = {}
    for host, members in by_host.items():
        counts = Counter(x for p in members for x in set(lines[p]))
        for p in members:
            out[p] = [x for x in lines[p] if not (host and counts[x] >= 3 and counts[x] / len(members) > 0.25)]
    return out


def test_boilerplate_lines(spark):
    random.seed(6)
    menu = ["menu", " home  page ", "imprint", "rare footer"]
    pages = []
    for p in range(120):
        host = random.choice(["a.example", "a.example", "b.example", "", None])
        body = [f"text {random.randint(0, 60)}" for _ in range(random.randint(0, 6))]
        pages.append((p, host, "\n".join([*random.sample(menu, 3), *body, *body[:1], ""])))
    pages += [(200, "c.example", "menu"), (201, "c.example", None), (202, None, None), (203, "a.example", ""), (204, "a.example", "w " * 50_000)]
    frame = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id int, site string, body string, host string, n_lines int")
    rows = line_dedup.drop_site_boilerplate(frame, F.col("site"), F.col("body")).collect()
    expected = plain_kept([(p, h or "", t) for p, h, t in pages])
    assert {r.page_id: r.text for r in rows} == {p: "\n".join(v) for p, v in expected.items()} and len(rows) == len(pages)
    assert sum(r.n_dropped for r in rows) > 100
    empty = spark.createDataFrame([], "page_id int, site string, body string")
    assert line_dedup.drop_site_boilerplate(empty, F.col("site"), F.col("body")).count() == 0


def test_page_text_and_host(spark):
    html = "<html><head><style>p{}</style><script>var t='</p>'; a<b</script></head><body><p>One\n two<br>Three <b>four</b></p><!-- no --><li>Five</body>"
    row = spark.createDataFrame([(html, "HTTPS://user@A.Example:80/x", "no url")], "h string, u string, v string").select(
        line_dedup.lines_of(line_dedup.page_text("h")), line_dedup.host_of("u"), line_dedup.host_of("v")
    ).first()
    assert list(row) == [["One two", "Three four", "Five"], "a.example", ""]
