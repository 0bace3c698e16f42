import hashlib
import math
import random
import re
from collections import Counter, defaultdict

from emberline.llm import pii
from emberline.llm.queries import QUERIES

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


#: In a small corpus a value's surroundings are a good part of all words.
SMALL = pii.PiiParams(least_bits=2.0)


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def good(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def values(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if good(k, m.group())]


def clean(word):
    low = re.sub(r"^[\W_]+|[\W_]+$", "", word)
    return "".join(c.lower() if c.isascii() else c for c in low)


def is_term(w):
    return len(w) > 2 and w[0].isalpha() and all(c.isalpha() or c in "'-" for c in w)


def terms(texts, p):
    """word -> least bits, by plain counting."""
    seen, rows = defaultdict(Counter), Counter(t for t in texts if t is not None)
    beside = defaultdict(int)
    for text, n in rows.items():
        for kind, pattern in PLAIN.items():
            ms = list(re.finditer(pattern, text))
            for i, m in enumerate(ms):
                if not good(kind, m.group()):
                    continue
                left = text[ms[i - 1].end() if i else 0 : m.start()]
                right = text[m.end() : ms[i + 1].start() if i + 1 < len(ms) else len(text)]
                left = re.sub(r"^[^\x20\x09-\x0D]+", "", left[-p.reach :]) if len(left) > p.reach else left
                right = re.sub(r"[^\x20\x09-\x0D]+\Z", "", right[: p.reach]) if len(right) > p.reach else right
                words = ["^", *map(clean, re.findall(r"[^\x20\x09-\x0D]+", left)), "@", *map(clean, re.findall(r"[^\x20\x09-\x0D]+", right)), "$"]
                value = re.sub("[^0-9]", "", m.group()) if kind in ("card", "phone") else m.group().lower()
                for a, w, b in zip(words, words[1:], words[2:]):
                    if is_term(w):
                        seen[(kind, value), w][a, b] += 1
                        beside[(kind, value), w] += n
    everywhere = Counter(w for t in texts if t is not None for w in map(clean, re.findall(r"[^\x20\x09-\x0D]+", t)) if is_term(w))
    around, out = Counter(), {}
    for (e, _), n in beside.items():
        around[e] += n
    for (e, w), contexts in seen.items():
        if sum(contexts.values()) >= p.support and max(contexts.values()) * p.support <= sum(contexts.values()):
            bits = max(math.log2(everywhere[w] / beside[e, w]), 0)
            if bits <= p.generalise_bits and math.log2(sum(everywhere.values()) / around[e]) - bits >= p.least_bits:
                out[w] = min(bits, out.get(w, 9))
    return out


def brute(text, hidden, p):
    """(base spans, all spans, sanitised)"""
    base = values(text)
    if text is None:
        return base, base, None
    more = []
    for m in re.finditer(r"[^\x20\x09-\x0D]+", text):
        w = clean(m.group())
        if w in hidden:
            a = m.start() + len(re.match(r"[\W_]*", m.group()).group())
            if not any(a < e and a + len(w) > s for _, s, e in base):
                more.append(("remove" if hidden[w] <= p.remove_bits else "generalise", a, a + len(w)))
    out, at = "", 0
    for a, b, k in sorted((a, b, k) for k, a, b in base + more):
        if a >= at:
            label = {"remove": "", "generalise": "[NAME]" if text[a].isupper() else "[TERM]"}
            out += text[at:a] + label.get(k, f"[{k.upper()}]")
        at = max(at, b)
    return base, base + sorted(more), out + text[at:]


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def compare(spark, texts, p):
    df = spark.createDataFrame([(i, t, "kept", i) for i, t in enumerate(texts)], "doc_id long, text string, spans string, extra int")
    got = {r.doc_id: r for r in pii.sanitise(df, p).collect()}
    hidden = terms(texts, p)
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        base, spans, text = brute(t, hidden, p)
        r = got[i]
        assert (r.text, r.extra) == (t, i)
        assert (r.base_spans, r.spans, r.sanitised) == (joined(base), joined(sorted(spans, key=lambda s: ([*PLAIN, "generalise", "remove"].index(s[0]), s[1]))), text)
        assert tuple(r[f"n_{k}"] for k in PLAIN) == tuple(sum(s[0] == k for s in base) for k in PLAIN)


def corpus(rng):
    common = ["".join(rng.choices("aeioubcdlmnrst", k=rng.randrange(3, 9))) for _ in range(60)]
    prose = lambda n: [rng.choice(common) for _ in range(n)]
    texts = []
    for _ in range(200):
        texts.append(" ".join(prose(rng.randrange(5, 60))) + ".")
    for i in range(12):  # Zephyrine stands only beside one address, Quill mostly
        mail = "Vera.Holt@mail.example.org" if i % 2 else "vera.holt@MAIL.example.org"
        texts.append(" ".join([*prose(9), "Zephyrine", *prose(3), mail, *prose(4), "(quillon)" if i < 7 else "lantern", *prose(30)]))
    texts += [" ".join([*prose(4), "quillon", *prose(4)]) for _ in range(3)]
    copied = " ".join([*prose(8), "onlyhere", *prose(8), "+1 (386) 555-3733", *prose(9)])
    texts += [copied] * 9 + [copied.replace(" ", "  ", 1)] * 2 + [copied + f" end{i}" for i in range(5)]
    return texts + ["onlyhere".join(["", " 10.2.3.4 "]), None, "", "no values"]


def test_method_against_plain_counting(spark):
    compare(spark, corpus(random.Random(4)), SMALL)
    hidden = terms(corpus(random.Random(4)), SMALL)
    assert {"zephyrine", "quillon"} <= set(hidden) and "onlyhere" not in hidden and hidden["zephyrine"] <= 0.25 < hidden["quillon"]


def test_paths_for_many_terms(spark):
    compare(spark, corpus(random.Random(4)), pii.PiiParams(least_bits=2.0, broadcast_words=0, broadcast_spans=0))


def test_edges_of_the_patterns(spark):
    rng = random.Random(1)
    texts = [
        "a@b.co_x@d.ef a@b@c.d.e .%+@-.- x@y. @b.c a@b..c", "1.2.3.4.5.6.7.8 300.1.2.3.4 0255.1.1.256 00012.1.1.1 1..2.3.4",
        "4111 1111-1111 1111 4111-1111-1111-11111 4111  1111 12 é4111111111111111é", "+1 (386) 555-3733+44 20 7946 0958 +1  +12 345 6789 +1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6",
        "€uro x@y.zz 𝄞𝄞 1.1.1.1 𝄞 +49.30.1234567", "\n1.2.3.4\t\n5.6.7.8", "+" * 50 + "1" * 40,
    ]
    alphabet = "a1.@+ -()9%_\né𝄞0"
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(400)]
    compare(spark, texts, pii.PiiParams())


def test_very_long_runs(spark):
    long_ = "a" * 300_000 + "@" + "b." * 20_000 + "c " + "1" * 300_000 + " " + "1 " * 50_000 + "+1" + " " * 200_000 + "9." * 100_000
    many = " ".join(f"10.0.{i % 256}.{i // 256}" for i in range(5_000))
    df = spark.createDataFrame([(1, long_), (2, many)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.sanitise(df).collect()}
    assert got[2].base_spans == joined(values(many)) and got[2].n_ip == 5_000 and got[2].sanitised == " ".join(["[IP]"] * 5_000)
    assert got[1].n_email == 1 and got[1].base_spans.startswith("email:0:340002")


def test_query_on_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    hidden = terms(list(texts.values()), pii.PiiParams())
    got = QUERIES["op11_pii"](spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        base, spans, _ = brute(texts[r.doc_id], hidden, pii.PiiParams())
        assert r.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest() and r.spans == joined(spans)
    assert sum(bool(r.spans) for r in got) > 10


def test_empty(spark):
    assert pii.sanitise(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert [r.spans for r in pii.sanitise(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect()] == ["", ""]
