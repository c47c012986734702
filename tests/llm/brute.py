"""Plain Python twins of the operators, for small tables: whole lists in memory, no hashing, no blocks."""

import math
import re
import zlib
from collections import Counter, defaultdict

from graphloom.llm import licences, perplexity, pii

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, k):
    found = WORD.findall((text or "").translate(LOWER))
    return {tuple(found[i : i + k]) for i in range(len(found) - k + 1)} if len(found) >= k else {tuple(found)} if found else set()


def components(texts, k, percent):
    """doc_id to the least reachable one, from all pairs of ``texts`` (doc_id to text)."""
    sets = {i: shingles(t, k) for i, t in texts.items()}
    comp = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and sets[i] and comp[i] != comp[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = comp[i], comp[j]
                comp = {n: min(a, b) if v in (a, b) else v for n, v in comp.items()}
    return comp


def contained(texts, items, k, percent):
    """(doc_id, item_id) of the items that a document contains."""
    out = set()
    for item, text in items.items():
        length = min(k, len(WORD.findall(text or "")))
        mine = shingles(text, k)
        if mine:
            out |= {(i, item) for i, t in texts.items() if 100 * len(mine & {g for g in shingles(t, length) if len(g) == length}) >= percent * len(mine)}
    return out


class KneserNey:
    """Interpolated modified Kneser-Ney of bytes, by dictionaries."""

    def __init__(self, texts, order=perplexity.ORDER):
        self.order = order
        counts = {order: Counter(g for t in texts for g in self.grams(t))}
        for size in range(order - 1, 0, -1):
            counts[size] = Counter(g[1:] for g in counts[size + 1])
        self.counts, self.cut, self.total, self.cuts = counts, {}, defaultdict(int), defaultdict(float)
        for size, table in counts.items():
            n1, n2, n3, n4 = (sum(n == i for n in table.values()) for i in (1, 2, 3, 4))
            self.cut[size] = (0.5, 0.5, 0.5)
            if n1 and n2 and n3:
                y = n1 / (n1 + 2 * n2)
                raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
                self.cut[size] = tuple(min(max(d, 0.1), i - 0.1) for i, d in enumerate(raw, 1))
            for g, n in table.items():
                self.total[size, g[:-1]] += n
                self.cuts[size, g[:-1]] += self.cut[size][min(n, 3) - 1]

    def grams(self, text):
        data = b"\n" * (self.order - 1) + text.encode()
        return [data[i : i + self.order] for i in range(len(data) - self.order + 1)]

    def p(self, gram):
        if not gram:
            return 1 / 256
        size, lower = len(gram), self.p(gram[1:])
        total = self.total.get((size, gram[:-1]), 0)
        if not total:
            return lower
        n = self.counts[size].get(gram, 0)
        return (n - (self.cut[size][min(n, 3) - 1] if n else 0) + self.cuts[size, gram[:-1]] * lower) / total

    def perplexity(self, text):
        found = self.grams(text)
        return math.exp(-sum(math.log(self.p(g)) for g in found) / len(found)) if found else None


def judged(rows, trusted):
    """doc_id to (perplexity, judged, threshold, kept); rows: (doc_id, text, lang), trusted: doc_id to held out."""
    model = KneserNey([t for i, t, _ in rows if t is not None and trusted.get(i) is False])
    score = {i: model.perplexity(t or "") for i, t, _ in rows}
    value = {i: score[i] and score[i] * math.exp(-perplexity.LENIENCE / math.sqrt(len(t.encode()))) for i, t, _ in rows}

    def limit(found):
        bins = sorted(math.ceil(v * 1000) for v in found)
        return bins[math.ceil(len(bins) * perplexity.QUANTILE) - 1] / 1000 * perplexity.SLACK if bins else None

    held = [(lang, value[i]) for i, _, lang in rows if trusted.get(i) and value[i] is not None]
    every = limit([v for _, v in held])
    own = {lang: limit([v for x, v in held if x == lang]) for lang in {x for x, _ in held}}
    out = {}
    for i, _, lang in rows:
        most = own.get(lang, every)
        out[i] = (score[i], value[i], most, value[i] is not None and (most is None or value[i] <= most))
    return out


def base_spans(text):
    """The contract's patterns as they stand."""
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(s):
        twice = [int(c) * (1 + i % 2) for i, c in enumerate(s[::-1])]
        return sum(d // 10 + d % 10 for d in twice) % 10 == 0

    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ]
    return [(kind, *m.span()) for kind, pattern, ok in kinds for m in re.finditer(pattern, text) if ok(m[0])]


def near_words(text, spans):
    """(entity, term, neighbourhood, start, end) of the words within the window of each span."""
    out, strip = [], lambda w: w.strip(".,;:!?\"'()").lower()
    for kind, a, b in spans:
        left = [(m.start(), m.end()) for m in WORD.finditer(text[:a])]
        right = [(m.start() + b, m.end() + b) for m in WORD.finditer(text[b:])]
        around = left[-pii.WINDOW - 1 :] + right[: pii.WINDOW + 1]
        inner = set(left[-pii.WINDOW :] + right[: pii.WINDOW])
        for i, (s, e) in enumerate(around):
            term = strip(text[s:e])
            if (s, e) in inner and len(term) > 1 and not any(s < y and x < e for _, x, y in spans):
                beside = (strip(text[slice(*around[i - 1])]) if i else "", strip(text[slice(*around[i + 1])]) if i + 1 < len(around) else "")
                start = s + max(0, text[s:e].lower().find(term))
                out.append(((kind, text[a:b].lower()), term, beside, start, start + len(term)))
    return out


def fold(word):
    return word.strip(".,;:!?\"'()").lower()


def all_spans(texts):
    """doc_id to (base spans, term spans (start, end, remove)), from the definition: corpus counts, then each word judged."""
    texts = {i: t or "" for i, t in texts.items()}
    base = {i: base_spans(t) for i, t in texts.items()}
    corpus, mentioned, near, beside = Counter(), Counter(), Counter(), defaultdict(set)
    for i, text in texts.items():
        corpus.update(fold(w) for w in WORD.findall(text))
        seen = set()
        for (kind, value), term, around, start, _ in near_words(text, base[i]):
            for entity in [(kind, value)] + [("domain", value.partition("@")[2])] * (kind == "email"):
                seen.add((entity, term, start))
                mentioned[entity] += 1
                beside[entity, term].add(around)
        near.update((entity, term) for entity, term, _ in seen)
    told = {}
    for (entity, term), n in near.items():
        if len(beside[entity, term]) >= pii.EVIDENCE and corpus[term]:
            p = math.ceil(mentioned[entity] / (2 * pii.WINDOW)) / sum(corpus.values())
            told[term] = max(told.get(term, 0), math.log(min(1, n / corpus[term]) / p) / -math.log(p))
    told = {term: v for term, v in told.items() if v >= pii.GENERALISE}
    hidden = secrets(texts, base)
    out = {}
    for i, text in texts.items():
        spans = dict(hidden[i])
        for m in WORD.finditer(text):
            start = m.start() + len(m[0]) - len(m[0].lstrip(".,;:!?\"'()"))
            end = start + len(m[0].strip(".,;:!?\"'()"))
            if fold(m[0]) in told and not any(start < y and x < end for _, x, y in base[i]):
                spans[start, end] = max(spans.get((start, end), 0), told[fold(m[0])])
        out[i] = (base[i], sorted((a, b, v >= pii.REMOVE) for (a, b), v in spans.items()))
    return out


def secrets(texts, base):
    """doc_id to {(start, end): disclosure} of the long runs that the corpus tells to be secrets."""
    pairs = Counter(p for t in texts.values() for p in zip(t.encode(), t.encode()[1:]))
    first = Counter()
    for (a, _), n in pairs.items():
        first[a] += n

    def bits(run, times):
        own = list(zip(run.encode(), run.encode()[1:]))
        rest = lambda counts, key, mine: max(0, counts[key] - times * mine.count(key))
        return sum(math.log2((rest(first, a, [x for x, _ in own]) + 256) / (rest(pairs, (a, b), own) + 1)) for a, b in own)

    found, around = [], defaultdict(set)
    for i, text in texts.items():
        places = [m.span() for m in WORD.finditer(text)]
        for m in re.finditer(r"[A-Za-z0-9+/_-]+", text):
            changes = len(re.findall(r"(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]", m[0]))
            if len(m[0]) >= pii.OPAQUE and changes >= pii.CHANGES and not any(m.start() < y and x < m.end() for _, x, y in base[i]):
                k = next(k for k, (a, b) in enumerate(places) if a <= m.start() < b)
                word = lambda k: fold(text[slice(*places[k])]) if 0 <= k < len(places) else ""
                around[m[0]].add((word(k - 1), word(k + 1)))
                found.append((i, m.span(), m[0]))
    out = {i: {} for i in texts}
    for i, span, run in found:
        value = 1 - math.log(len(around[run])) / math.log(max(2, sum(pairs.values())))
        if value >= pii.SECRET and bits(run, sum(r == run for _, _, r in found)) >= pii.BITS:
            out[i][span] = value
    return out


def cleaned(text, base, terms):
    """The text with its spans replaced, leftmost first."""
    marks = [(a, b, f"[{kind.upper()}]") for kind, a, b in base] + [(a, b, "" if gone else "[NAME]" if text[a].isupper() else "[TERM]") for a, b, gone in terms]
    out, at = "", 0
    for a, b, mark in sorted(marks):
        if a >= at:
            out += text[at:a] + mark
        at = max(at, b)
    return out + text[at:]


def pieces(texts, encode, size=4096):
    """Sorted (doc_id, piece, start, length, crc) and the number of bins of best-fit decreasing."""
    out = []
    for i, t in texts.items():
        ids = [*encode(t or ""), 1]
        out += [(i, k // size, k, len(ids[k : k + size]), zlib.crc32(b"".join(n.to_bytes(4, "little") for n in ids[k : k + size]))) for k in range(0, len(ids), size)]
    left = []
    for n in sorted((x[3] for x in out), reverse=True):
        fit = [b for b in range(len(left)) if left[b] >= n]
        if fit:
            left[min(fit, key=lambda b: left[b])] -= n
        else:
            left.append(size - n)
    return sorted(out), len(left)


def licence_rows(texts, model):
    """(doc_id, first line, lines, family) of each notice in (doc_id, text) rows: every line and paragraph scored by the model's weights."""
    split = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]
    pairs = lambda w: [f"{a} {b}" for a, b in zip(w, w[1:])]
    weights = {r["feature"]: r["weights"] for r in model.weights.collect()}
    marks = [(f, set(pairs(split(t)) or split(t))) for f, t in licences.known_texts()]
    none = model.classes.index("none")

    def judge(line):
        words = split(line)
        features = set(words) | set(pairs(words))
        logits = [b + sum(weights[f][i] for f in features if f in weights) for i, b in enumerate(model.intercepts)]
        best = max(range(len(logits)), key=lambda i: (logits[i], -i))
        if best == none:
            return None
        probability = 1 / sum(math.exp(x - logits[best]) for x in logits)
        near = max((len(t & features) / len(t) for f, t in marks if f == model.classes[best]), default=0)
        sure = near >= licences.CONFIRM and probability > model.believed and not features & set(licences.EXTENDED)
        others = [f for f, named in licences.NAMED.items() if features & set(named) and f != model.classes[best]]
        return [model.classes[best], *others] if sure else ["unknown"], sure

    out = []
    for doc, text in texts:
        block = []
        for i, line in [*enumerate(re.sub("\r\n?", "\n", text or "").split("\n")), (-1, "")]:
            if line.strip():
                block.append((i, line))
                continue
            single = [(i, 1, judge(x)) for i, x in block]
            single = [x for x in single if x[2]]
            whole = judge(" ".join(x for _, x in block)) if len(block) > 1 else None
            if any(v[1] for _, _, v in single):
                stay = [x for x in single if x[2][1] or not (whole and whole[1])]
            elif whole and whole[1] or whole and not single:
                stay = [(block[0][0], len(block), whole)]
            else:
                stay = single
            out += [(doc, i, n, family) for i, n, v in stay for family in v[0]]
            block = []
    return out
