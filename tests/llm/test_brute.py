"""Operators that SQL can't express, against plain Python: discovery of personal data, scores of the classifier."""

import collections
import re

import numpy as np
from test_ops import brute_spans, docs

from shelfmark.llm import pii

BREAK = r"\s\"'<>()\[\]{},;"


def brute_pii(texts, rounds=3, support=5, confidence=0.7):
    """Spans of each text: base ones, and tokens that trusted patterns introduce."""
    norm = lambda words: re.sub("[0-9]+", "0", " ".join(words[-2:]).lower())
    found = []
    for t in texts:
        t = t or ""
        words = [(m.start(), m.end()) for m in re.finditer(f"[^{BREAK}]+", t)]
        base = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in brute_spans(t))]
        mine = []
        for kind, a, b in base:
            i = max(k for k, w in enumerate(words) if w[0] <= a)
            before = [t[x:y] for x, y in words[:i]] + ([t[words[i][0] : a]] if words[i][0] < a else [])
            mine.append((kind, a, b, norm(before), t[a:b].lower()))
        for i, (a, b) in enumerate(words):
            b = a + len(re.sub(r"[.,:!?%#*&$|-]+$", "", t[a:b]))
            if re.search("[0-9@]", t[a:b]) and b - a >= 5 and not any(x < b and a < y for _, x, y in base):
                mine.append(("token", a, b, norm([t[x:y] for x, y in words[:i]]), t[a:b].lower()))
        found.append(mine)
    seed = {}
    for kind, _, _, pattern, instance in (s for mine in found for s in mine):
        if pattern:
            seed[pattern, instance] = max(filter(None, (seed.get((pattern, instance)), kind if kind != "token" else None)), default=None)
    by = collections.defaultdict(list)
    for p, i in seed:
        by[p].append(i)
    by = {p: i for p, i in by.items() if len(i) >= support}
    sown = collections.defaultdict(set)
    for (p, i), k in seed.items():
        if p in by and k:
            sown[i].add(k)
    belief = {(i, k): [1.0] for i, ks in sown.items() for k in ks}
    for _ in range(rounds):
        trust = collections.defaultdict(float)
        for p, instances in by.items():
            for i in instances:
                for (x, k), values in belief.items():
                    if x == i:
                        trust[p, k] += sum(values) / (len(instances) + 1)
        belief = {(i, k): [1.0] for i, ks in sown.items() for k in ks}
        fresh = {}
        for p, instances in by.items():
            for i in instances:
                if not seed[p, i]:
                    for (q, k), c in trust.items():
                        if q == p:
                            fresh[i, k] = max(fresh.get((i, k), 0), c)
        for at, c in fresh.items():
            belief.setdefault(at, []).append(c)
    best = {}
    for (p, k), c in trust.items():
        if c >= confidence:
            best[p] = max(best.get(p, (0, "")), (c, k))
    out = []
    for mine in found:
        spans = {(pii.KINDS.index(k), a, b) for k, a, b, _, _ in mine if k != "token"}
        spans |= {(pii.KINDS.index(best[p][1]), a, b) for k, a, b, p, _ in mine if k == "token" and p in best}
        out.append(",".join(f"{pii.KINDS[r]}:{a}:{b}" for r, a, b in sorted(spans)))
    return out


def test_pii_discovery_by_brute_force(spark):
    rng = np.random.default_rng(11)
    pick = lambda x: x[int(rng.integers(len(x)))]
    lead = ["id 12345 handle", "contact email:", "call me", "reach (host)", "server", "12345, 678901;", "Write To", "x"]
    value = [lambda k: f"user{k}@mail.com", lambda k: f"joe{k % 7}_at_site", lambda k: f"10.0.{k % 256}.1", lambda k: f"+1 (974) 555-{1000 + k % 50}", lambda k: "4111 1111 1111 1111", lambda k: f"ref-{k:05d}.", lambda k: f"<k{k}@a.org>"]
    texts = []
    for k in range(160):
        parts = [pick(["some words", "and", "", "A B C", "nothing 1 2", "é 😀"]) + " " + pick(lead) + pick([" ", ":", " \n"]) + pick(value)(int(rng.integers(400))) for _ in range(int(rng.integers(0, 4)))]
        texts.append(" ".join(parts) + pick(["", " end", ","]))
    got = {r.doc_id: r.spans for r in pii.scan(docs(spark, list(enumerate(texts)))).collect()}
    want = brute_pii(texts)
    assert [got[i] for i in range(len(texts))] == want
    assert sum(len(w.split(",")) for w in want) > sum(len(brute_spans(t)) for t in texts)


def test_pii_context_does_not_depend_on_the_kind(spark):
    """Numbers before an identifier are part of its context, whether it is a seed or a token."""
    texts = [(i, f"id 12345 handle user{i}@mail.com now") for i in range(12)] + [(100, "id 12345 handle joe77_at_site now"), (101, "id 1 handle joe77_at_site now"), (102, f"id {'9' * 200} handle joe78_at_site now")]
    got = {r.doc_id: r.spans for r in pii.scan(docs(spark, texts)).collect()}
    assert got[100] == "email:16:29" and got[101] == "email:12:25" and got[102] == "email:211:224"


def test_quality_by_brute_force(spark):
    """Rates, strengths and scores of every row again from the formulas, given the document model's scores."""
    from shelfmark.llm import quality

    rng = np.random.default_rng(8)
    texts = [(i, "word " * int(rng.integers(1, 60)) + "#!" * int(rng.integers(0, 30) * (i % 3 == 0))) for i in range(300)] + [(None, "no id"), (7, "again " * 9), (301, None), (302, "")]
    rows = [(i, t, f"l{rng.integers(3)}" if k % 9 else None, f"s{min(5, int(rng.geometric(0.4)))}" if k % 11 else None) for k, (i, t) in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = {i: int(i % 3 > 0) for i in range(150)}
    table = spark.createDataFrame([*labels.items(), (7, 0), (None, 1), (200, None)], "doc_id long, quality int")
    known = {**{k: [v] for k, v in labels.items()}}
    known[7] = known[7] + [0]
    got = quality.classify(d.withColumn("at", d.source), table, carry=("at", "lang", "text")).collect()
    assert len(got) == len(rows)
    e = np.array([np.mean(known[r.doc_id]) if r.doc_id in known else r.doc_score for r in got])
    host, path = [r["at"] for r in got], [(r["at"], r.lang) for r in got]
    sums = lambda keys: {k: (sum(k == x for x in keys), sum(v for x, v in zip(keys, e, strict=True) if x == k)) for k in set(keys)}
    hosts, paths = sums(host), sums(path)
    mu = (e.sum() + 1) / (len(e) + 2)

    def strength(groups, prior):
        many = [(n, s, prior(k)) for k, (n, s) in groups.items() if n >= 2]
        n = sum(x[0] for x in many)
        between = max(1e-6, (sum(a * (s / a - p) ** 2 for a, s, p in many) - sum(p * (1 - p) for _, _, p in many)) / n)
        return min(1e4, max(1.0, np.mean([p * (1 - p) for _, _, p in many]) / between - 1))

    kh = strength(hosts, lambda k: mu)
    kp = strength(paths, lambda k: (hosts[k[0]][1] + kh * mu) / (hosts[k[0]][0] + kh))
    logit = lambda p: np.log(np.clip(p, 1e-6, 1 - 1e-6) / (1 - np.clip(p, 1e-6, 1 - 1e-6)))
    for r, own in zip(got, e, strict=True):
        n, s = hosts[r["at"]]
        h = (max(0.0, s - own) + kh * mu) / (n - 1 + kh)
        n, s = paths[r["at"], r.lang]
        p = (max(0.0, s - own) + kp * h) / (n - 1 + kp)
        score = 1 / (1 + np.exp(-(logit(r.doc_score) + logit(p) - np.log(mu / (1 - mu)))))
        assert abs(r.host_rate - h) < 1e-9 and abs(r.path_rate - p) < 1e-9 and abs(r.score - score) < 1e-9 and r.keep == (r.score >= 0.5)
