"""Personal data: patterns, and spans added by a semi-Markov conditional random field."""

import functools
import math
import random
import re

import numpy as np

from candlewright.llm.spans import free, scan

KINDS = ("email", "ip", "card", "phone")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(text):
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text):
    """The e-mail pattern, read outwards from each '@' so that long runs cost no more than their length."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(last, at + 1))


def _addresses(text):
    """Four dotted numbers, taken from the left of each run of dotted numbers."""
    for m in DOTTED.finditer(text):
        run = m.group()
        if run.count(".") < 3:
            continue
        parts, start = run.split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            end = start + sum(map(len, parts[i:i + 4])) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in parts[i:i + 4]):
                yield start, end
            start = end + 1


def base_spans(text):
    """Spans of the four patterns by kind, then start; matches that fail their test are dropped."""
    found = [("email", a, b) for a, b in _emails(text)]
    if not DIGIT.search(text):
        return found
    found += [("ip", a, b) for a, b in _addresses(text)]
    for m in CARD.finditer(text):
        d = _digits(m.group())
        if 13 <= len(d) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return found


# --- semi-Markov conditional random field ---------------------------------------------

LONGEST = 40  # tokens of an entity: a card of 19 digits written one by one has 37
# What separates parts, such as ' [dot] ' or '. ' between digits, is one token, so that entities of many parts fit.
TOKEN = re.compile(r"(?<=[0-9])[ .\/-]{2,3}(?=[0-9])|[ \t]?[\[({<] ?(?i:dot|at) ?[\])}>][ \t]?|[0-9]+|[^\W\d_]+|[ \t]+|.", re.S)
# Stretches that may hold an entity: long numbers with separators, and addresses around an at-sign or its word.
NUMERIC = re.compile(r"[+(\[]*[0-9](?:[0-9 \t().\-/\[\]]*[0-9])?")
DIGIT = re.compile(r"[0-9]")
AT = re.compile(r"(?:@|[\[({<] ?at ?[\])}>]| at )", re.I)
SIDE = 48  # code points on either side of an at-sign that belong to its stretch at least
# The host behind an at-sign, however long; it belongs to the stretch, too.
HOST = re.compile(r"\s?[\w-]+(?:\s?(?:\.|[\[({<] ?dot ?[\])}>]| dot )\s?[\w-]+)*", re.I)
DOT = {"dot", "punkt", "punto", "point"}


def tokens(text, start, end):
    return [m.span() for m in TOKEN.finditer(text, start, end)]


def _last_word(text, start):
    words = re.findall(r"[^\W\d_]+", text[max(0, start - 16):start])
    return words[-1].lower() if words else ""


# A separator with another part behind it.
MORE = re.compile(r"\s?(?:[.\-/]|[\[({<] ?dot ?[\])}>]| dot )\s?[0-9A-Za-z]", re.I)


def _more(text, end):
    """Whether a host goes on: behind a written separator, or a dot without a blank."""
    m = MORE.match(text, end)
    sign = m.group()[:-1] if m else ""
    return "dot" if sign == "." else "written" if "o" in sign.lower() else ""


def segment_features(text, start, end, kind):
    """Features of a whole candidate span of a kind; none if it cannot be of that kind."""
    body = text[start:end]
    digits = _digits(body)
    marks = "".join(sorted(set(re.sub(r"[0-9A-Za-z]", "", body))))
    before, after = text[start - 1:start], text[end:end + 1]
    out = [f"before={_last_word(text, start)}", f"marks={marks}",
           f"edge={int(before.isalnum())}{int(after.isalnum())}", f"attached={before if before in '.-/_:' else ''}"
           f"{after if after in '-/_:' else ''}"]
    if kind == "email":
        m = re.fullmatch(r"([\w.+-]+)\s?(@|[\[({<] ?at ?[\])}>]| at )\s?(.+)", body, re.I)
        if not m or body[-1] in "])}> ":
            return None
        host = re.split(r"\s?(?:\.|[\[({<] ?dot ?[\])}>]| dot )\s?", m[3], flags=re.I)
        sign = "@" if m[2] == "@" else "(at)" if m[2].strip() != m[2][1:-1].strip() and m[2][0] != " " else "at"
        hidden = bool(re.search(r"[\[({< ]dot[\])}> ]", m[3], re.I))
        whole = len(host) > 1 and all(re.fullmatch(r"[A-Za-z0-9-]+", h) for h in host)
        return out[:1] + [f"at={sign},{int(hidden)},{int(whole)}", f"more={_more(text, end)}", f"joined={before in set('.-_+')}", f"top={host[-1].isalpha() and 2 <= len(host[-1]) <= 6}",
                          f"spaces={' ' in m[3]},{hidden}"]
    if re.search(r"[^\W\d_]", body):
        return None
    groups = re.findall(r"[0-9]+", body)
    shape = "-".join(str(len(g)) for g in groups)
    if kind == "ip":
        if len(groups) != 4 or not re.fullmatch(r"[0-9]+(?:\s?(?:\[\.\]|\(\.\)|\.)\s?[0-9]+){3}", body):
            return None
        return out + [f"range={all(len(g) < 4 and int(g) < 256 for g in groups)}"]
    if kind == "card":
        if not 13 <= len(digits) <= 19:
            return None
        return out + [f"luhn={luhn(digits)}", f"luhn={luhn(digits)},marks={marks}", f"shape={shape}", f"first={digits[0]}"]
    if not 7 <= len(digits) <= 15:
        return None
    return out + [f"shape={shape}", f"head={body[0] if body[0] in '+(' else '00' if body[:2] == '00' else ''}",
                  f"count={len(digits)}", f"groups={len(groups)},{body[:1] == '('}"]


def candidates(text, spans):
    """(first token, token after the last, kind, features) of a stretch's candidate segments."""
    for i, (a, _) in enumerate(spans):
        if text[a].isspace() or text[a] in ")].,;:-/":
            continue
        for j in range(i + 1, min(i + LONGEST, len(spans)) + 1):
            b = spans[j - 1][1]
            if not text[b - 1].isalnum():
                continue
            for kind in KINDS:
                features = segment_features(text, a, b, kind)
                if features is not None:
                    yield i, j, kind, [f"{kind}|{f}" for f in features] + [kind]


def best_segments(n, scored):
    """The highest-scoring way to cut ``n`` tokens into entities and single other tokens (score 0)."""
    ends = {}
    for i, j, kind, score in scored:
        ends.setdefault(j, []).append((i, kind, score))
    best, back = [0.0] * (n + 1), [None] * (n + 1)
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for i, kind, score in ends.get(j, ()):
            if best[i] + score > best[j]:
                best[j], back[j] = best[i] + score, (i, kind)
    out, j = [], n
    while j:
        if back[j] is None:
            j -= 1
        else:
            out.append((back[j][0], j, back[j][1]))
            j = back[j][0]
    return out[::-1]


def _marginals(n, scored):
    """Probability of each candidate segment under the model (forward and backward sums)."""
    ends, starts = {}, {}
    for k, (i, j, _, score) in enumerate(scored):
        ends.setdefault(j, []).append((i, score, k))
        starts.setdefault(i, []).append((j, score, k))
    fore, hind = [0.0] * (n + 1), [0.0] * (n + 1)
    for j in range(1, n + 1):
        fore[j] = np.logaddexp.reduce([fore[j - 1], *(fore[i] + s for i, s, _ in ends.get(j, ()))])
    for i in range(n - 1, -1, -1):
        hind[i] = np.logaddexp.reduce([hind[i + 1], *(hind[j] + s for j, s, _ in starts.get(i, ()))])
    return [math.exp(fore[i] + s + hind[j] - fore[n]) for i, j, _, s in scored]


def _examples(seed, count):
    """Generated sentences with their entities: (text, [(kind, start, end)])."""
    rng = random.Random(seed)
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice(("an", "er", "is", "to", "la", "me", "on", "ti", "de")) for _ in range(rng.randint(1, 3)))

    def card():
        while True:
            d = rng.choice("3456") + num(15)
            if luhn(d):
                return d

    def email():
        user, host, top = word() + rng.choice(("", ".", "_")) + word(), word() + rng.choice(("", "9")), rng.choice(("com", "org", "de", "net", "io"))
        at = rng.choice((" (at) ", "(at)", " [at] ", "[at]", " at ", " @ ", "@"))
        dot = rng.choice((" (dot) ", "[dot]", " dot ")) if at not in (" @ ", "@") or rng.random() < .3 else "."
        dot = " dot " if at == " at " else dot
        parts = [word() for _ in range(rng.choice((0, 0, 1, 2)))] + [top]
        return user.replace("_", ".") + at + dot.join([host, *parts])

    def ip():
        return rng.choice(("[.]", "(.)", " . ")).join(str(rng.randint(0, 255)) for _ in range(4))

    def phone():
        a, b, c = num(3), num(3), num(4)
        return rng.choice((f"({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{num(2)} {a} {b} {c}",
                           f"00{num(2)} {num(2)} {num(7)}", f"({a}){b}-{c}", f"1-{a}-{b}-{c}"))

    def no():
        a = num(16)
        while luhn(a):
            a = num(16)
        return rng.choice((
            a, f"{a[:4]}.{a[4:8]}.{a[8:12]}.{a[12:]}", f"{a[:4]}/{a[4:8]}/{a[8:12]}/{a[12:]}", num(rng.randint(1, 20)),
            f"{num(4)}-{num(2)}-{num(2)}", f"{num(2)}.{num(2)}.{num(4)}", f"{num(2)}/{num(2)}/{num(4)} {num(2)}:{num(2)}",
            f"{num(1)}.{num(1)}.{num(2)}", f"{num(1)}.{num(2)}.{num(1)}.{num(4)}", f"{num(3)} {num(3)} {num(3)}",
            f"{num(2)} {num(2)} {num(2)} {num(2)} {num(2)}", f"978-{num(1)}-{num(4)}-{num(4)}-{num(1)}", f"{num(3)}.{num(6)}",
            f"{num(7)}", f"{num(10)}", f"{num(5)}-{num(4)}", f"{num(4)} - {num(4)}", f"({num(4)})", f"({num(2)}) {num(4)}",
            f"{word()} at {word()}", f"at {word()} dot", f"{word()} @{word()}", f"{word()} at {word()}. {word()}",
            f"look at the dot {word()}", f"{num(1)} . {num(1)} . {num(1)}", f"{num(8)}-{num(4)}-{num(4)}-{num(12)}",
            f"{num(2)}.{num(3)}.{num(3)}", f"{num(1)},{num(3)},{num(3)}", f"{num(4)}:{num(4)}:{num(4)}"))

    cues = {"email": ("mail", "contact", "email", "write"), "ip": ("ip", "host", "server", "address"),
            "card": ("card", "visa", "credit", "paid"), "phone": ("call", "phone", "tel", "fax", "mobile")}
    makers = {"email": email, "ip": ip, "phone": phone,
              "card": lambda: rng.choice((".", "/", "  ", " . ")).join(re.findall("....", card()))}
    for _ in range(count):
        text, gold = word(), []
        for _ in range(rng.randint(1, 2)):
            kind = rng.choice((*KINDS, None, None, None, None))
            lead = rng.choice(cues[kind] if kind and rng.random() < .5 else (word(), word(), word() + "."))
            text += f" {lead}{rng.choice((' ', ' ', ': '))}"
            body = makers[kind]() if kind else no()
            if kind:
                gold.append((kind, len(text), len(text) + len(body)))
            text += body + rng.choice((" ", " ", ". ", ", ")) + word()
        yield text, gold


@functools.lru_cache(maxsize=2)
def trained(seed=42, count=500, epochs=4, rate=0.25, decay=1e-4):
    """Weights of the field: gradient ascent on the likelihood of generated sentences.

    The examples are the four kinds in the written forms that the patterns do not cover,
    and numbers and phrases that only look like them. Weights of seldom features are
    drawn to zero.
    """
    data = []
    for text, gold in _examples(seed, count):
        spans = tokens(text, 0, len(text))
        found = list(candidates(text, spans))
        right = {(k, s, e) for k, s, e in gold}
        data.append((len(spans), found, [(kind, spans[i][0], spans[j - 1][1]) in right for i, j, kind, _ in found]))
    weights, order, rng = {}, list(range(len(data))), random.Random(seed)
    for _ in range(epochs):
        rng.shuffle(order)
        for at in order:
            n, found, right = data[at]
            if not found:
                continue
            scored = [(i, j, kind, sum(weights.get(f, -1.0 if f == kind else 0.0) for f in fs)) for i, j, kind, fs in found]
            for (_, _, kind, fs), p, y in zip(found, _marginals(n, scored), right):
                for f in fs:
                    w = weights.get(f, -1.0 if f == kind else 0.0)
                    weights[f] = w + rate * ((1.0 if y else 0.0) - p) - decay * w
    return weights


MARGIN = 2.0  # how much better than no entity a segment must be


def _has_at(text):
    """Whether a text may hold an at-sign, its word in brackets, or its word with a 'dot' to go with it."""
    low = text.lower()
    return "@" in low or " dot " in low or any(f"{a}{b}" in low for a in ("at", "at ") for b in "])}>")


def _host_end(text, at):
    m = HOST.match(text, at)
    return min(len(text), max(at + SIDE, m.end() if m else 0))


def stretches(text, base):
    """(start, end) parts of a text that may hold further entities, between the base spans."""
    found = [m.span() for m in NUMERIC.finditer(text) if m.end() - m.start() >= 7
             and sum(map(str.isdigit, m.group())) >= 4] if DIGIT.search(text) else []
    found += [] if not _has_at(text) else [(max(0, m.start() - SIDE), _host_end(text, m.end())) for m in AT.finditer(text)
              if m.group() != " at " or re.search(r"\sdot\s", text[m.end():m.end() + SIDE], re.I)]
    taken = sorted((a, b) for _, a, b in base)
    out = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    k = 0
    for a, b in out:
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        at, m = a, k
        while m < len(taken) and taken[m][0] < b:
            if taken[m][0] > at:
                yield at, taken[m][0]
            at = max(at, taken[m][1])
            m += 1
        if at < b:
            yield at, b


def added_spans(text, base, weights):
    """Spans that joint decoding finds besides the base spans, which it leaves as they are."""
    found = []
    for start, end in stretches(text, base):
        parts = tokens(text, start, end)
        for first in range(0, len(parts), 4096):  # a longer stretch is one number after another
            spans = parts[first:first + 4096 + LONGEST]
            scored = [(i, j, kind, score - MARGIN) for i, j, kind, fs in candidates(text, spans)
                      if (score := sum(weights.get(f, -1.0 if f == kind else 0.0) for f in fs)) > MARGIN]
            found += [(kind, spans[i][0], spans[j - 1][1]) for i, j, kind in best_segments(len(spans), scored) if i < 4096]
    return free(sorted(set(found)), base)


def spans_of(text, weights):
    base = base_spans(text)
    added = added_spans(text, base, weights)
    return base, sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1]))


def personal_data(docs):
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, added), see :func:`spans.scan`.

    Counts and digest are of the patterns' spans; the field adds spans of the same kinds
    in other written forms, which overlap none of them. Spans go by kind, then start.
    """
    weights = trained()
    return scan(docs, lambda text: spans_of(text, weights), KINDS)
