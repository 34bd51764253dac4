"""Secret scans: patterns, and assignments lexed from source and configuration text."""

import functools
import math
import re
from collections import Counter

from candlewright.llm.spans import free, scan

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")


def base_spans(text):
    """Spans of the three patterns by start, then kind as listed."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m.group()) >= 16]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


# The tokens of an assignment, common to programs, shells, YAML, INI, TOML and JSON.
_LEX = r"""
    (?P<comment>{block}(?:(?<=\s)|^)(?:\#|//)[^\n]*)
  | (?P<text>(?:\b[bBrRuUfF]{1,2})?(?P<long>{long})(?P<lines>(?:\\[\s\S]|(?!(?P=long))[^\\])*+)(?P=long))
  | (?P<string>(?P<prefix>\b[bBrRuUfF]{1,2})?(?P<quote>{quotes})(?P<body>(?:\\.|(?!(?P=quote))[^\\\n])*+)(?P=quote))
  | (?P<name>\$?\{?[A-Za-z_][A-Za-z0-9_]*(?:[.\-][A-Za-z_][A-Za-z0-9_]*)*\}?)
  | (?P<number>\d[A-Za-z0-9_+/=.-]*)
  | (?P<op>:=|=>|==|!=|<=|>=|[=:])
  | (?P<join>[+&]|\.\.)
  | (?P<line>\n)
  | (?P<space>[\x20\t]+)
  | (?P<other>.)
"""
LONG = ('"""', "'''")  # strings that go over lines
QUOTES = (*LONG, '"', "'", "`")


@functools.cache
def _lex(openers):
    """The tokens when only these quotes and block comments can still be closed."""
    quotes = "|".join(q for q in QUOTES if q in openers and q not in LONG) or "(?!)"
    long = "|".join(q for q in LONG if q in openers) or "(?!)"
    return re.compile(_LEX.replace("{block}", r"/\*[\s\S]*?\*/ | " if "/*" in openers else "").replace(
        "{long}", long).replace("{quotes}", quotes), re.X | re.M)


LEX = _lex((*QUOTES, "/*"))
STATEMENT = re.compile(r"[=:]")
ASSIGNS = {"=", ":", ":=", "=>"}
BARE = re.compile(r"[A-Za-z0-9+/_.=@!#$%^&*~-]*+")
HEADER = re.compile(r"[|>][+\-0-9]{0,2}[ \t]*(?:\#[^\n]*)?\r?\n")  # of a block of lines in YAML

# What the parts of a target's name say about its literal.
SENSITIVE = {"password": 4, "passwd": 4, "pwd": 4, "passphrase": 4, "passcode": 4, "pass": 3, "secret": 4, "token": 3,
             "apikey": 4, "credential": 3, "credentials": 3, "auth": 2, "authorization": 3, "bearer": 3, "private": 2,
             "key": 2, "api": 1, "access": 1, "signing": 1, "encryption": 1, "master": 1, "client": 0.5, "salt": 2,
             "dsn": 2, "webhook": 1, "jwt": 3, "session": 1, "cookie": 2, "kennwort": 4, "passwort": 4, "contraseña": 4}
HARMLESS = {"length": 4, "len": 4, "name": 3, "path": 3, "file": 3, "url": 2, "uri": 2, "host": 2, "type": 3, "id": 1,
            "public": 4, "label": 3, "field": 3, "hint": 3, "regex": 4, "pattern": 4, "prompt": 4, "message": 3,
            "error": 3, "count": 4, "limit": 4, "max": 3, "min": 3, "timeout": 4, "expiry": 3, "ttl": 4, "test": 1,
            "header": 2, "placeholder": 5, "primary": 2, "foreign": 2, "sort": 2, "partition": 2, "cache": 1, "query": 3, "sql": 4,
            "template": 3, "help": 3, "doc": 3, "description": 3}
FAKE = re.compile(r"^(?:x+|\*+|\.+|<.*>|\$\{.*\}|\{\{.*\}\}|%\(.*\)s|your[_-].*|.*(?:example|placeholder|changeme|change_me"
                  r"|redacted|dummy|todo).*|none|null|nil|true|false|undefined|default|string|localhost)$", re.I)
ENOUGH = 6.0


def name_parts(name):
    """Lower-case parts of camelCase, snake_case, dotted and dashed names."""
    spaced = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ", name)
    return [p.lower() for p in re.split(r"[^A-Za-zÀ-ÿ0-9]+", spaced) if p]


def name_score(name):
    parts = name_parts(name)
    joined = "".join(parts)
    best = sum(SENSITIVE.get(p, 0) for p in set(parts)) + (2 if "apikey" in joined or "accesskey" in joined else 0)
    return best - sum(HARMLESS.get(p, 0) for p in set(parts)) if best else 0.0


def literal_score(value):
    """How much a literal looks like a chosen or generated secret: length, mix and entropy; line ends count once."""
    if "\n" in value:
        value = "\n".join(line.strip() for line in value.split("\n") if line.strip())
    if len(value) < 6 or FAKE.match(value) or len(set(value)) < 4:
        return -10.0
    counts = Counter(value)
    bits = -sum(n / len(value) * math.log2(n / len(value)) for n in counts.values())
    kinds = sum(bool(re.search(c, value)) for c in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9\\s]"))
    prose = sum(map(value.count, " \t\r\n")) / len(value) * 12
    return min(2.0, len(value) / 12) + min(2.0, bits / 2) + 0.7 * (kinds - 1) - prose


BLOCK, SHORT = 1 << 16, 1 << 12
LONGEST = 1 << 14  # characters from which a constant is named in a chain, not copied into it
REST = 1 << 10  # of a run of characters without blanks, what a sign of assignment but the first takes at most


CHAINED = re.compile(r"\([ \t\r\n]*\Z|(?:[+&]|\.\.)[ \t]*(?:(?:\#|//)[^\n]*)?[ \t\r\n]*\Z|(?:key|name)[\"']?[ \t]*[=:][^\n]*[ \t\r\n]*\Z", re.I)


STRING_ENDS, STRING_BEGINS = re.compile(r"[\"'][ \t\r]*\n\Z"), re.compile(r"[ \t]*(?:[bBrRuUfF]{0,2}[\"']|\))")


def _goes_on(text, start, end):
    """Whether a statement may go on behind the line that ends here."""
    line = text.rfind("\n", start, end - 1) + 1 or start
    return bool(CHAINED.search(text, line, end)
                or STRING_BEGINS.match(text, end) and STRING_ENDS.search(text, line, end))


def _blocks(text):
    """(start, end) of stretches of whole lines, of about 64 KB or one longer line, statement or string."""
    pairs = [(q, q) for q in LONG] + [("/*", "*/")]
    final = {closer: text.rfind(closer) for _, closer in pairs}
    start = 0
    while start < len(text):
        end = start + BLOCK
        if end < len(text):
            end = text.rfind("\n", start, end) + 1 or text.find("\n", end) + 1 or len(text)
            held = {q: text.count(q, start, end) for pair in pairs for q in pair}
            while end < len(text):
                border = text.find("\n", end) + 1 or len(text)
                if not _goes_on(text, start, end):
                    ahead = [text.find(closer, end) for opener, closer in pairs if final[closer] >= end and (
                        held[opener] % 2 if opener == closer else held[opener] > held[closer])]
                    if not ahead:
                        break
                    border = text.find("\n", min(ahead)) + 1 or len(text)
                for q in held:
                    held[q] += text.count(q, end, border)
                end = border
        yield start, min(end, len(text))
        start = end


def _last(text, start, end, closer):
    """Where the last ``closer`` of the stretch stands that no backslash escapes; -1 if there is none."""
    at = text.rfind(closer, start, end)
    while at >= 0 and closer != "*/":
        before = at
        while before > start and text[before - 1] == "\\":
            before -= 1
        if (at - before) % 2 == 0:
            break
        at = text.rfind(closer, start, at + len(closer) - 1)
    return at


def _matches(text, start, end):
    """The tokens of a stretch, in time linear in its length.

    Otherwise each quote without an end would be followed to the end of the line or stretch. So
    what opens a token is left out of the pattern behind the last place that can close it.
    """
    if end - start <= min(BLOCK, SHORT):
        yield from LEX.finditer(text, start, end)
        return
    closers = {q: _last(text, start, end, q) for q in QUOTES} | {"/*": _last(text, start, end, "*/")}
    while start < end:
        openers = tuple(q for q in closers if closers[q] > start)
        border = min((closers[q] for q in openers), default=end)
        for m in _lex(openers).finditer(text, start, end):
            yield m
            start = m.end()
            if start >= border:
                break


class _Tokens:
    """The tokens of a stretch, read when asked for; those long passed are dropped."""

    def __init__(self, text, start, end):
        self._more = (m for m in _matches(text, start, end) if m["space"] is None and m["comment"] is None)
        self._held, self._first = [], 0

    def has(self, k):
        while k - self._first >= len(self._held):
            m = next(self._more, None)
            if m is None:
                return False
            self._held.append(m)
        return True

    def __getitem__(self, k):
        return self._held[k - self._first]

    def drop(self, k):
        if k - self._first > 1 << 14:
            del self._held[:k - self._first]
            self._first = k


def assignments(text):
    """(name, value, pieces) of the literals given to names; pieces are (start, end) in the text.

    The right-hand side is a chain of strings, numbers and names joined by '+', '&' or
    '..'; names of constants stand for their values and lead to where those were written. That is
    the value given last before, or, for names that are given one only after their use, the
    last one of all; a chain ends at a name that never gets one. In configuration lines a bare word
    may be the literal. A chain may go on in the next line behind its joining sign, and between
    brackets strings that follow each other are one. Strings in three quotes may
    hold lines, as may indented blocks behind ``name: |`` and ``name: >``. Where an entry names
    its key and its value apart (``key="…" value="…"``, ``name: …`` and ``value: …``), the key is the
    name. Other statements end with their line, so a text is lexed in stretches of whole lines,
    however long. Constants of chains above 16,384 characters are kept as parts of a chain, which
    other chains share, so that statements that add to a constant again and again take linear time.
    """
    for name, parts in _given(text):
        pieces = list(_written(parts, set()))
        yield name, "".join(text[a:b] for a, b in pieces), pieces


class _Chain:
    """The items of a constant that is too long to be copied into every chain that names it.

    ``ends`` tells, once it is settled, that a name without a value ends it, and what is around it; it is
    ``"word"`` if all it has is the bare word written there, which counts at the beginning only.
    """

    def __init__(self, items):
        self.items, self.ends = items, None


FAKE_WORD = re.compile("example|placeholder|changeme|change_me|redacted|dummy|todo", re.I)
FAKE_FRAMES = (("<", ">"), ("${", "}"), ("{{", "}}"), ("%(", ")s"))
EDGE = 16  # characters kept of both ends; longer than any fake word
CLASSES = [re.compile(c) for c in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9\\s]")]


class _Long:
    """The value of a long chain: its parts, and what its score needs to know of it.

    Pieces over lines count without the blanks of their lines, each by itself. ``shares`` are the
    characters' shares of the whole; parts named twice count twice.
    """

    def __init__(self, text, parts):
        self.parts, self.length, self.shares = parts, 0.0, {}
        self.lines = self.fake = False
        self.head = self.tail = ""
        for part in parts:
            if isinstance(part, _Long):
                self._add(part.length, part.shares, part.lines, part.fake, part.head, part.tail)
            else:
                piece = text[part[0]:part[1]]
                lines = "\n" in piece
                if lines:
                    piece = "\n".join(line.strip() for line in piece.split("\n") if line.strip())
                if piece:
                    self._add(float(len(piece)), {c: n / len(piece) for c, n in Counter(piece).items()}, lines,
                              bool(FAKE_WORD.search(piece)), piece[:EDGE], piece[-EDGE:])

    def _add(self, length, shares, lines, fake, head, tail):
        if not length:
            return
        both = self.length + length
        for c in self.shares:
            self.shares[c] *= self.length / both
        for c, share in shares.items():
            self.shares[c] = self.shares.get(c, 0.0) + share * (length / both)
        self.lines |= lines
        self.fake |= fake or bool(FAKE_WORD.search(self.tail + head))
        self.head = (self.head + head)[:EDGE]
        self.tail = (self.tail + tail)[-EDGE:]
        self.length = min(both, 1e300)

    def score(self):
        """:func:`literal_score` of the value."""
        framed = any(self.head.startswith(a) and self.tail.endswith(b) for a, b in FAKE_FRAMES)
        if len(self.shares) < 4 or not self.lines and (
                self.fake or framed or re.match("your[_-]", self.head, re.I)):
            return -10.0
        bits = -sum(s * math.log2(s) for s in self.shares.values() if s)
        seen = "".join(self.shares)
        prose = sum(self.shares.get(c, 0.0) for c in " \t\r\n") * 12
        return min(2.0, self.length / 12) + min(2.0, bits / 2) + 0.7 * (sum(bool(c.search(seen)) for c in CLASSES) - 1) - prose


def _written(parts, met):
    """(start, end) of all pieces, in order; chains that are in ``met`` are left out, others put there."""
    todo = list(reversed(parts))
    while todo:
        part = todo.pop()
        if part in met:
            continue
        met.add(part)
        if isinstance(part, _Long):
            todo += reversed(part.parts)
        else:
            yield part


def _given(text):
    """(name, parts) of :func:`assignments`, pieces or long values; those that need further constants come last."""
    known, waiting = {}, []
    for start, end in _blocks(text):
        if STATEMENT.search(text, start, end):
            for name, items in _assigned(text, _Tokens(text, start, end), known):
                if any(isinstance(item, _Chain) or len(item) == 3 for item in items):
                    waiting.append((name, items))
                else:
                    yield name, items
    settled = {}
    for name, items in waiting:
        _settle(_needed(items, known), known, settled, text)
        parts, _ = _parts(items, settled, text)
        if parts:
            yield name, parts


def _key(item):
    """What an item's value is settled under: a chain itself, or the name of a constant; None of a literal."""
    return item if isinstance(item, _Chain) else item[0] if len(item) == 3 else None


def _needed(items, known):
    return [k for k in map(_key, items) if isinstance(k, _Chain) or k in known]


def _settle(keys, known, settled, text):
    """Adds the parts of constants and chains to ``settled``; a name that leads back to itself has none there."""
    todo, begun = list(keys), set()
    while todo:
        key = todo[-1]
        items = () if key in settled else key.items if isinstance(key, _Chain) else known[key]
        needs = [] if key in begun else [n for n in _needed(items, known) if n not in settled and n not in begun]
        begun.add(key)
        if needs:
            todo += needs
        else:
            if key not in settled:
                settled[key], ends = _parts(items, settled, text)
                if isinstance(key, _Chain):
                    key.ends = ends
            todo.pop()


def _parts(items, settled, text):
    """The pieces and long values of a chain up to the first name without a value, and what ended it there."""
    out = []
    for item in items:
        key = _key(item)
        ends = key.ends if isinstance(key, _Chain) else None
        if key is None:
            out.append(item)
        elif settled.get(key) and not (out and ends == "word"):
            out = _joined(out, settled, key, lambda parts: _Long(text, parts))
        elif key is item or out or not item[2]:
            ends = "name"
        else:
            return [item[1:]], "word"
        if ends:
            return out, ends
    return list(dict.fromkeys(out)), None


def _joined(items, values, key, whole):
    """``items`` and those of ``values[key]`` without repeats; what is too long is made one item there, by ``whole``."""
    both = list(dict.fromkeys((*items, *values[key])))
    if sum(LONGEST + 1 if isinstance(i, (_Chain, _Long)) else 1 if len(i) == 3 else i[1] - i[0] for i in both) <= LONGEST:
        return both
    if len(values[key]) > 1:
        values[key] = [whole(values[key])]
    return list(dict.fromkeys((*items, *values[key])))


BEHIND = 8  # tokens looked back at, at most


def _entry_key(tokens, k):
    """The key of an entry that gives it just before its value, ending at token ``k`` or before a line end or comma."""
    low = max(k - 3, 2)
    for between in ("\n", "\r", ","):
        if k >= low and tokens[k].group() == between:
            k -= 1
    if k < low or tokens[k - 1]["op"] not in ASSIGNS:
        return None
    label = tokens[k - 2]["name"] or tokens[k - 2]["body"] or ""
    return (tokens[k]["name"] or tokens[k]["body"]) if label.lower() in {"key", "name"} else None


def _inner(t):
    """Where the content of a string token stands; outer blanks of a string over lines do not count."""
    if t["string"] is not None:
        return t.span("body")
    start, end = t.span("lines")
    body = t["lines"]
    return start + len(body) - len(body.lstrip()), max(end - len(body) + len(body.rstrip()), start + len(body) - len(body.lstrip()))


def _block_of_lines(text, target, at):
    """(start, end) of the indented lines behind a header at ``at``, without outer blanks, and where they end."""
    head = HEADER.match(text, at)
    if not head:
        return None
    line = text.rfind("\n", 0, target) + 1
    indent = len(text[line:target]) - len(text[line:target].lstrip(" "))
    m = re.compile(r"(?:[ \t]*\r?\n|[ ]{%d,}[^\n]*(?:\n|\Z))*+" % (indent + 1)).match(text, head.end())
    body = m.group()
    start = m.start() + len(body) - len(body.lstrip())
    return start, max(start, m.start() + len(body.rstrip())), m.end()


def _past_lines(tokens, k):
    while tokens.has(k) and (tokens[k]["line"] or tokens[k].group() == "\r"):
        k += 1
    return k


def _assigned(text, tokens, known):
    """(name, items) of the statements of a stretch.

    An item is (start, end) of a literal, or (name, start, end) of a constant without a value so
    far, with the bare word that stands there if it gets none, else zeros, or a :class:`_Chain`.
    """
    i, run, inside = -1, (0, 0), 0
    while tokens.has(i := i + 1):
        if not i & 4095:
            tokens.drop(i - BEHIND)
        t = tokens[i]
        if t["op"] not in ASSIGNS or not i:
            continue
        target = tokens[i - 1]
        name = target["name"] or target["body"]
        if i > 2 and t["op"] == "=" and tokens[i - 2]["op"] == ":":  # a typed declaration: name: type = literal
            name = (tokens[i - 3]["name"] or name) if tokens[i - 3]["name"] else name
        if i > 1 and target["other"] == "]" and tokens[i - 2]["body"] is not None:  # settings["name"] = literal
            name = tokens[i - 2]["body"]
        if name and name.lower() == "value":
            name = _entry_key(tokens, i - 2) or name
        if not name:
            continue
        items, k, follows = [], i + 1, True
        wrapped = tokens.has(k) and tokens[k]["other"] == "("
        if wrapped:
            k = _past_lines(tokens, k + 1)
        elif tokens.has(k) and t["op"] == ":" and tokens[k]["other"] in ("|", ">") and t.start() >= inside:
            block = _block_of_lines(text, target.start(), tokens[k].start())
            if block:
                inside, follows = block[2], False
                items = [block[:2]] if block[0] < block[1] else []
        while follows and tokens.has(k):
            u = tokens[k]
            own = u["name"].strip("${}") if u["name"] is not None and (
                not tokens.has(k + 1) or tokens[k + 1]["op"] is None) else None
            bare = (0, 0)
            if k == i + 1 and (u["name"] or u["number"] or u["other"]):
                at = u.start()
                if at >= run[1]:
                    run = at, BARE.match(text, at).end()
                if run[1] - at >= 8 and (run[1] == len(text) or text[run[1]].isspace() or text[run[1]] in ",;") and (
                        at == run[0] or run[1] - at <= REST):
                    bare = at, run[1]
            if u["string"] is not None or u["text"] is not None:
                items.append(_inner(u))
            elif own in known:
                items = _joined(items, known, own, _Chain)
            elif own and (not bare[1] or bare[1] == u.end()):
                items.append((own, *bare))
            elif bare[1]:
                items.append(bare)
                break
            else:
                break
            k += 1
            if wrapped:
                k = _past_lines(tokens, k)
            follows = tokens.has(k) and tokens[k]["join"] is not None
            if follows:
                k = _past_lines(tokens, k + 1)
            elif wrapped:
                follows = tokens.has(k) and (tokens[k]["string"] is not None or tokens[k]["text"] is not None)
        if wrapped and not (tokens.has(k) and tokens[k]["other"] == ")"):
            continue
        if items:
            known[name.strip("${}")] = known[name.strip("${}").rpartition(".")[2]] = items
            yield name.strip("${}"), items


NAMES = re.compile("|".join(sorted(map(re.escape, SENSITIVE), key=len, reverse=True)), re.I)


def lexed_spans(text):
    """('literal', start, end) of literals whose target names and looks say secret."""
    if not STATEMENT.search(text) or not NAMES.search(text):
        return []
    found, met = set(), set()
    for name, parts in _given(text):
        n = name_score(name)
        if n < 2:
            continue
        long = any(isinstance(part, _Long) for part in parts)
        score = _Long(text, parts).score() if long else literal_score("".join(text[a:b] for a, b in parts))
        if n + score >= ENOUGH:
            found.update(("literal", a, b) for a, b in (_written(parts, met) if long else parts) if b - a >= 4)
    return sorted(found, key=lambda s: s[1])


def spans_of(text):
    base = base_spans(text)
    added = free(lexed_spans(text), base)
    return base, sorted(base + added, key=lambda s: (s[1], (*KINDS, "literal").index(s[0])))


def secrets(docs):
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, added), see :func:`spans.scan`.

    The patterns' spans stay as they are; lexing adds spans of kind ``literal`` that
    overlap none of them. Spans go by start, then kind.
    """
    return scan(docs, spans_of, KINDS)
