"""Main text of web pages by wrappers: union-free regular-expression inference over same-host pages.

A page's tokens, tags and texts, are read once; what tags enclose is a token stream of its own. A wrapper is
a union-free expression over such streams: a sequence of elements, groups of elements and texts, each
required, optional (?), repeated (+) or both (*). The pages of a host are aligned one after another with the
host's wrapper, stream by stream. Neighbours that repeat, one kind or up to four in turn, fold into a repeated
group where the two sides have different numbers of them; what one side lacks becomes optional; where texts
differ stands a slot, and the texts that all pages have at a place are its constants. The same alignment joins the wrappers of two sets of pages, so
each task infers from its own pages, and a host's partial wrappers are joined in two steps whatever the
number of its pages. A stream keeps its best supported members, so that random names do not make a wrapper
grow; a page's tokens that a wrapper does not know are not lost, they are only unknown.

The wrapper decides what to take. The article is the element whose slots hold most of the text, among
article and main elements where there are such; constants, which pages share, weigh nothing. A page is
aligned with the wrapper from its root down to that place. Where no article element marks it, a text in it
goes if the wrapper has it as a constant of all pages, unless most of the text is such. Elements that are no
article by their kind (menus, headers, footers, sidebars, notices, adverts, forms, scripts, comments) are
left out wherever they stand.

Null or empty html gives an empty text, as does a page without text. A page that does not have the wrapper's
article, and the only page of a host, are read by a wrapper of their own, in which all text weighs. Pages
without a host share one wrapper. Repeated rows and ids are fine, further columns take no part, and an empty
table gives no rows. Elements nested more than DEPTH deep lose their nesting, not their text.
"""

from __future__ import annotations

import html as markup
import json
import re
from bisect import bisect_left
from collections.abc import Iterable

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import materialise

#: Groups in which a host's partial wrappers are joined first; bytes of all rules that are sent to every
#: executor, beyond which rules and pages are joined by host; characters of rules that a task keeps at hand.
FIRST_JOIN, SEND_BYTES, KEPT_CHARS = 64, 16 << 20, 64 << 20
#: Levels of a page; elements in turn that make a group; members of a stream and nodes of a wrapper that are
#: kept by support; cells of an alignment table beyond which streams are aligned by kinds that occur once.
DEPTH, GROUP, MEMBERS, NODES, CELLS = 64, 4, 200, 20_000, 1 << 16
#: Constants up to this length stand in a wrapper themselves, longer ones by their hash.
SPELLED = 200

#: HTML's element classes.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe object svg math select option button canvas audio video".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Elements that a start tag of the same group ends.
SIBLINGS = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "thead": "tr td th", "tbody": "tr td th thead", "tfoot": "tr td th tbody"}
SIBLINGS = {k: frozenset(v.split()) for k, v in SIBLINGS.items()}
#: Elements and name parts of what is no article.
ASIDE = frozenset("nav footer aside form script style noscript template iframe object svg button select dialog menu head".split())
ASIDE_NAME = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|sidebar|side|footer|foot|ads?|adv|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|"
    r"comments?|commentlist|replies|reply|respond|disqus|discussion|share|sharing|social|related|recommend\w*|breadcrumbs?|pagination|pager|newsletter|subscribe|signup|login|search|toolbar|widget|masthead|topbar|skip|copyright|legal|tags|byline-share)(?:$|[\s_-])"
)
HEADER_NAME = re.compile(r"(?:^|[\s_-])header(?:$|[\s_-])")
MAIN_NAME = re.compile(r"(?:^|[\s_-])(?:article|articlebody|post|entry|story|content|main|body|text)(?:$|[\s_-])")

_token = re.compile(r"<!--.*?-->|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
_named = re.compile(r"""(?:^|[\s"'])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_digits = re.compile(r"\d+")
_raw_end = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in RAW}


def kind_of(tag: str, names: str) -> str:
    """Tag and names, with numbers folded and names that look drawn at random left open."""
    if not names:
        return tag
    folded = [_digits.sub("#", x) for x in names.split()]
    return f"{tag}.{' '.join('#' if x.count('#') > 1 else x for x in folded)}"


class Element:
    """A block-level element: its kind, whether it is set aside, what it holds in order."""

    __slots__ = ("kind", "tag", "items", "links", "names")

    def __init__(self, tag: str, names: str):
        self.tag, self.names, self.items, self.links = tag, names, [], 0
        self.kind = kind_of(tag, names)


def parse(page: str) -> Element:
    """A tolerant reading of a page: every text lands in a block, every element is closed somewhere.

    Below DEPTH a new element shares its parent's place, unless it is to be set aside.
    """
    root = Element("", "")
    stack: list[tuple[str, Element, int]] = [("", root, 0)]
    open_tags: dict[str, int] = {}
    text, in_link, at, n = [], 0, 0, len(page)

    def flush() -> None:
        if text:
            if block := " ".join(markup.unescape("".join(text)).split()):
                stack[-1][1].items.append(block)
            text.clear()

    def close(place: int) -> None:
        for tag, _, _ in stack[place:]:
            open_tags[tag] -= 1
        del stack[place:]

    while at < n:
        m = _token.search(page, at)
        if m is None:
            text.append(page[at:])
            break
        if m.start() > at:
            text.append(page[at : m.start()])
            if in_link:
                stack[-1][1].links += m.start() - at
        at = m.end()
        if m.group(2) is None:
            continue
        tag = m.group(2).lower()
        if m.group(1):
            if tag in INLINE:
                in_link = max(0, in_link - 1) if tag == "a" else in_link
            elif tag == "br":
                flush()
            elif open_tags.get(tag):
                flush()
                place = len(stack) - 1
                while stack[place][0] != tag:
                    place -= 1
                close(place)
                in_link = 0
            continue
        if tag in INLINE:
            in_link += tag == "a"
            continue
        flush()
        in_link = 0
        if tag in VOID:
            continue
        if tag in RAW:
            end = _raw_end[tag].search(page, at)
            if not m.group(3).endswith("/") and (end or tag in ("script", "style")):
                at = end.start() if end else n
            continue
        if tag in CLOSES_P and stack[-1][0] == "p":
            close(len(stack) - 1)
        if tag in SIBLINGS:
            group = SIBLINGS[tag]
            while stack[-1][0] in group or stack[-1][0] == "p":
                close(len(stack) - 1)
        names = " ".join((x or y or z).strip().lower() for _, x, y, z in _named.findall(m.group(3))) if m.group(3) else ""
        _, parent, depth = stack[-1]
        if depth < DEPTH or depth == DEPTH and set_aside(tag, names, True):
            element = Element(tag, names)
            parent.items.append(element)
            depth += 1
        else:
            element = parent
        stack.append((tag, element, depth))
        open_tags[tag] = open_tags.get(tag, 0) + 1
    flush()
    return root


def set_aside(tag: str, names: str, inside: bool) -> bool:
    """Whether an element is no part of an article; a header inside the article is."""
    if not inside and (tag == "header" or names and HEADER_NAME.search(names)):
        return True
    return tag in ASIDE or bool(names and tag not in ("html", "body", "article", "main") and ASIDE_NAME.search(names))


# A wrapper is a list: kind, quantifier, pages, text characters, link characters, constants, members. Kinds are "#" of a
# text, "(a b)" of a group of kinds a and b, else an element's. Constants, of texts only, are what all pages have there.
KIND, QUANTIFIER, PAGES, CHARS, LINKS, CONSTANTS, MEMBERS_OF = range(7)
TEXT = "#"
QUANTIFIERS = {(x, y): "*" if "*" in (x, y) or {x, y} == {"?", "+"} else "+" if "+" in (x, y) else "?" if "?" in (x, y) else "" for x in ("", "?", "+", "*") for y in ("", "?", "+", "*")}


def spelled(text: str) -> str:
    """A text as it stands among constants."""
    return text if len(text) <= SPELLED else f"\0{len(text)}:{xxhash.xxh3_128_hexdigest(text.encode('utf-8', 'surrogatepass'))}"


def length_of(constant: str) -> int:
    return int(constant[1:].partition(":")[0]) if constant[:1] == "\0" else len(constant)


class Run:
    """One or more neighbours in a stream that repeat: of one kind, their places, or of several in turn, the runs of each turn."""

    __slots__ = ("kind", "places", "turns")

    def __init__(self, kind: str, places: list[int] | None, turns: list[list[Run]] | None = None):
        self.kind, self.places, self.turns = kind, places, turns


def group_kind(kinds: list[str]) -> str:
    return f"({' '.join(kinds)})"


def runs(kinds: list[str], known: Iterable[tuple[str, ...]] = ()) -> list[Run]:
    """A stream of kinds with its repetitions folded; patterns in `known` make a group even when they stand once."""
    out: list[Run] = []
    for place, kind in enumerate(kinds):
        if out and out[-1].kind == kind:
            out[-1].places.append(place)
        else:
            out.append(Run(kind, [place]))
    for width in range(2, GROUP + 1):
        single = {p for p in known if len(p) == width}
        if len(out) < width or not single and len(out) < 2 * width:
            continue
        old, out, at = out, [], 0
        names = [r.kind for r in old]
        while at < len(old):
            pattern, times = names[at : at + width], 1
            if len(pattern) == width:
                while names[at + times * width : at + (times + 1) * width] == pattern:
                    times += 1
            if len(pattern) == width and (times > 1 or tuple(pattern) in single):
                out.append(Run(group_kind(pattern), None, [old[at + t * width : at + (t + 1) * width] for t in range(times)]))
                at += times * width
            else:
                out.append(old[at])
                at += 1
    return out


def fold(element: Element) -> list:
    """The wrapper of one page: all required, all constant."""
    made = [[TEXT, "", 1, len(x), 0, [spelled(x)], []] if isinstance(x, str) else fold(x) for x in element.items]
    return [element.kind, "", 1, 0, element.links, [], made]


def folded(run: Run, members: list) -> list:
    """The members of a run as one repeated member."""
    parts = [members[p] for p in run.places] if run.turns is None else [[run.kind, "", max(members[p][PAGES] for p in places(turn)), 0, 0, [], [folded(r, members) for r in turn]] for turn in run.turns]
    one = parts[0]
    for x in parts[1:]:
        one = join(one, x, within=True)
    again = len(parts) > 1
    return [one[KIND], "*" if again and one[QUANTIFIER] in ("?", "*") else "+" if again and not one[QUANTIFIER] else one[QUANTIFIER], *one[PAGES:]]


def places(turn: list[Run]) -> list[int]:
    """The places in a stream that some runs take."""
    return [p for r in turn for p in (r.places if r.turns is None else [q for t in r.turns for q in places(t)])]


def join(a: list, b: list, within: bool = False) -> list:
    """The least wrapper of the form that both are cases of; within: both are of the same page."""
    members = streams(a[MEMBERS_OF], b[MEMBERS_OF], within)
    if a[KIND] == TEXT:
        other = set(b[CONSTANTS])
        constants = [*a[CONSTANTS], *(other - set(a[CONSTANTS]))] if within else [x for x in a[CONSTANTS] if x in other]
    else:
        constants = []
    return [a[KIND], QUANTIFIERS[a[QUANTIFIER], b[QUANTIFIER]], max(a[PAGES], b[PAGES]) if within else a[PAGES] + b[PAGES], a[CHARS] + b[CHARS], a[LINKS] + b[LINKS], constants, members]


def streams(left: list, right: list, within: bool) -> list:
    """Two streams of members as one."""
    if [x[KIND] for x in left] == [x[KIND] for x in right]:
        return [join(x, y, within) for x, y in zip(left, right)]
    one, other = [x[KIND] for x in left], [x[KIND] for x in right]
    known = {*patterns(left), *patterns(right)}
    known |= {tuple(x.kind for x in r.turns[0]) for r in (*runs(one), *runs(other)) if r.turns}
    ours, theirs = runs(one, known), runs(other, known)
    out: list = []
    for i, j in aligned([r.kind for r in ours], [r.kind for r in theirs]):
        if i is not None and j is not None:
            x, y = (places([r]) for r in (ours[i], theirs[j]))
            if len(x) == len(y):  # as many on both sides: each for itself
                out += [join(left[p], right[q], within) for p, q in zip(x, y)]
            else:
                out.append(join(folded(ours[i], left), folded(theirs[j], right), within))
        else:
            some, run = (left, ours[i]) if j is None else (right, theirs[j])
            out += [[m[KIND], QUANTIFIERS[m[QUANTIFIER], "?"], *m[PAGES:]] for m in (some[p] for p in places([run]))]
    if len(out) > MEMBERS:
        best = sorted(range(len(out)), key=lambda i: (-out[i][PAGES], i))[:MEMBERS]
        out = [out[i] for i in sorted(best)]
    return out


def patterns(members: list) -> tuple[tuple[str, ...], ...]:
    return tuple(tuple(x[KIND] for x in m[MEMBERS_OF]) for m in members if m[KIND][:1] == "(")


def aligned(left: list[str], right: list[str]) -> list[tuple[int | None, int | None]]:
    """A longest alignment of two streams of kinds by place; what stands alone is paired with None."""
    head = 0
    while head < min(len(left), len(right)) and left[head] == right[head]:
        head += 1
    tail = 0
    while tail < min(len(left), len(right)) - head and left[-1 - tail] == right[-1 - tail]:
        tail += 1
    rows, columns = len(left) - head - tail, len(right) - head - tail
    matches = common(left[head : head + rows], right[head : head + columns])
    pairs = [*((i, i) for i in range(head)), *((head + i, head + j) for i, j in matches), *((len(left) - tail + t, len(right) - tail + t) for t in range(tail))]
    out: list[tuple[int | None, int | None]] = []
    i = j = 0
    for x, y in [*pairs, (len(left), len(right))]:
        out += [*((p, None) for p in range(i, x)), *((None, q) for q in range(j, y))]
        if x < len(left):
            out.append((x, y))
        i, j = x + 1, y + 1
    return out


def common(left: list[str], right: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence; of very long streams one of the kinds that both have once."""
    rows, columns = len(left), len(right)
    if rows * columns <= CELLS:
        best = [[0] * (columns + 1) for _ in range(rows + 1)]
        for i in range(rows - 1, -1, -1):
            for j in range(columns - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if left[i] == right[j] else max(best[i + 1][j], best[i][j + 1])
        found, i, j = [], 0, 0
        while i < rows and j < columns:
            if left[i] == right[j]:
                found.append((i, j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
        return found
    once = [{k: p for p, k in enumerate(s) if count[k] == 1} for s in (left, right) for count in [_counts(s)]]
    places = sorted((p, once[1][k]) for k, p in once[0].items() if k in once[1])
    ends: list[int] = []  # longest rising sequence of the right places
    chains: list[tuple] = []
    for i, j in places:
        at = bisect_left(ends, j)
        chain = (i, j, chains[at - 1] if at else None)
        if at == len(ends):
            ends.append(j)
            chains.append(chain)
        else:
            ends[at], chains[at] = j, chain
    found, chain = [], chains[-1] if chains else None
    while chain:
        found.append(chain[:2])
        chain = chain[2]
    return found[::-1]


def _counts(kinds: list[str]) -> dict[str, int]:
    out: dict[str, int] = {}
    for k in kinds:
        out[k] = out.get(k, 0) + 1
    return out


def bounded(wrapper: list, most: int = NODES) -> list:
    """The wrapper without its least supported optional members, until it has `most` nodes."""

    def supports(w: list, out: list) -> list:
        for x in w[MEMBERS_OF]:
            out.append(x[PAGES])
            supports(x, out)
        return out

    def cut(w: list, least: int) -> list:
        return [*w[:MEMBERS_OF], [cut(x, least) for x in w[MEMBERS_OF] if x[PAGES] >= least]]

    found = sorted(supports(wrapper, []), reverse=True)
    return cut(wrapper, found[most] + 1) if len(found) > most else wrapper


def expression(wrapper: list) -> str:
    """A wrapper in regular-expression form: constants as they stand, slots as #TEXT."""
    inside = " ".join(map(expression, wrapper[MEMBERS_OF]))
    if wrapper[KIND] == TEXT:
        shown = " ".join([*map(repr, wrapper[CONSTANTS]), *(["#TEXT"] if varying(wrapper) else [])])
        return shown if not wrapper[QUANTIFIER] else f"({shown}){wrapper[QUANTIFIER]}"
    if wrapper[KIND][:1] == "(":
        return f"({inside}){wrapper[QUANTIFIER]}"
    return f"(<{wrapper[KIND]}>{' ' if inside else ''}{inside} </>){wrapper[QUANTIFIER]}" if wrapper[KIND] else inside


def varying(leaf: list) -> int:
    """Characters of a text's place that are no constant."""
    return max(0, leaf[CHARS] - leaf[PAGES] * sum(map(length_of, leaf[CONSTANTS])))


def inner(wrapper: list) -> list[tuple[list, int, int | None]]:
    """The elements of a wrapper's stream, those of groups too: (element, member, place in the group)."""
    out = []
    for i, m in enumerate(wrapper[MEMBERS_OF]):
        if m[KIND][:1] == "(":
            out += [(x, i, j) for j, x in enumerate(m[MEMBERS_OF]) if x[KIND] != TEXT and x[KIND][:1] != "("]
        elif m[KIND] != TEXT:
            out.append((m, i, None))
    return out


def texts(wrapper: list) -> list[list]:
    """The texts that stand directly in an element."""
    found = []
    for m in wrapper[MEMBERS_OF]:
        found += [m] if m[KIND] == TEXT else [x for x in m[MEMBERS_OF] if x[KIND] == TEXT] if m[KIND][:1] == "(" else []
    return found


def rules(wrapper: list) -> dict:
    """What the wrapper decides: the way to the article, stream by stream, and the constants in it."""
    candidates: list[tuple[float, tuple, int, list]] = []

    def mass(w: list, inside: bool, weigh) -> int:
        tag, _, names = w[KIND].partition(".")
        if set_aside(tag, names, inside):
            return 0
        return max(0, sum(map(weigh, texts(w))) - 2 * w[LINKS]) + sum(mass(x, inside, weigh) for x, _, _ in inner(w))

    weigh = varying if mass(wrapper, True, varying) else lambda leaf: leaf[CHARS]

    def visit(w: list, path: tuple) -> None:
        tag, _, names = w[KIND].partition(".")
        if set_aside(tag, names, False):
            return
        weight = mass(w, True, weigh)
        marked = tag in ("article", "main") or "main" in names.split() or bool(names and MAIN_NAME.search(names))
        if weight:
            candidates.append((weight * (1 + 0.001 * len(path)), path, 3 if tag == "article" else 2 if marked else 0, w))
        for x, i, j in inner(w):
            visit(x, (*path, (w, i, j)))

    visit(wrapper, ())
    if not candidates:
        return {"way": None, "constants": {}}
    total = max(c[0] for c in candidates)
    strong = [c for c in candidates if c[2] and c[0] >= 0.5 * total] or [c for c in candidates if c[2] == 3]
    if strong:
        kind = max(c[2] for c in strong)
        best = max((c for c in strong if c[2] == kind), key=lambda c: c[0])
    else:
        best = max((c for c in candidates if c[0] >= 0.8 * total), key=lambda c: len(c[1]))
    way = [[[m[KIND] for m in w[MEMBERS_OF]], [list(p) for p in patterns(w[MEMBERS_OF])], i, j, w[MEMBERS_OF][i][QUANTIFIER] in ("+", "*")] for w, i, j in best[1]]
    return {"way": way, "constants": shared(best[3]) if best[2] < 3 else {}}


def shared(article: list) -> dict[str, list[str]]:
    """By path in the article the texts that all pages have there; none where that is most of the text."""
    found: dict[str, list[str]] = {}
    chars = [0, 0]

    def visit(w: list, path: str) -> None:
        tag, _, names = w[KIND].partition(".")
        if path and set_aside(tag, names, True):
            return
        for leaf in texts(w):
            chars[0] += leaf[CHARS]
            if leaf[PAGES] == article[PAGES] and leaf[CONSTANTS]:
                chars[1] += leaf[CHARS] - varying(leaf)
                found.setdefault(path, []).extend(leaf[CONSTANTS])
        for x, _, _ in inner(w):
            visit(x, f"{path}/{x[KIND]}")

    visit(article, "")
    return found if article[PAGES] > 1 and 2 * chars[1] <= chars[0] else {}


def follow(root: Element, way: list) -> list[Element]:
    """The elements of a page at the end of a rule's way: each stream is aligned with the wrapper's."""
    found = [root]
    for kinds, known, i, j, repeated in way:
        known = tuple(map(tuple, known))
        after = []
        for e in found:
            theirs, ours = runs(kinds, known), runs([x.kind if isinstance(x, Element) else TEXT for x in e.items], known)
            for p, q in aligned([r.kind for r in theirs], [r.kind for r in ours]):
                if p is None or q is None or i not in (own := places([theirs[p]])):
                    continue
                met = places([ours[q]])
                if j is not None:  # in a group
                    met = [m for t in ours[q].turns or () for m in places([t[j]])]
                elif not repeated:
                    met = [met[own.index(i)]] if len(own) == len(met) else []
                after += [e.items[m] for m in met]
        found = after
    return found


def extract(page: str | None, rule: dict | None) -> str:
    """The blocks of the page's article, joined by line breaks."""
    if not page:
        return ""
    root = parse(page)
    found = follow(root, rule["way"]) if rule and rule["way"] is not None else []
    if not any(holds_text(e) for e in found):
        rule = rules(fold(root))
        found = follow(root, rule["way"]) if rule["way"] is not None else []
    gone = {path: frozenset(some) for path, some in rule["constants"].items()}
    blocks: list[str] = []

    def take(element: Element, path: str) -> None:
        if path and set_aside(element.tag, element.names, True):
            return
        drop = gone.get(path, ())
        for x in element.items:
            if isinstance(x, str):
                if not drop or spelled(x) not in drop:
                    blocks.append(x)
            else:
                take(x, f"{path}/{x.kind}")

    for element in found:
        take(element, "")
    return "\n".join(blocks)


def holds_text(element: Element) -> bool:
    return any(isinstance(x, str) or not set_aside(x.tag, x.names, True) and holds_text(x) for x in element.items)


PARTIAL = T.StructType([T.StructField("host", T.StringType()), T.StructField("part", T.LongType()), T.StructField("wrapper", T.StringType())])


def host() -> Column:
    """A page's host in lower case; empty where its URL has none."""
    return F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)", 1))


def infer(pages: DataFrame) -> DataFrame:
    """host, wrapper of all pages: partial wrappers by task, joined in two steps."""

    def start(batches):
        found: dict[str, list] = {}
        for batch in batches:
            for name, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                if page:
                    w = fold(parse(page))
                    found[name] = bounded(join(found[name], w) if name in found else w)
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([part] * len(found), pa.int64()), pa.array([json.dumps(w) for w in found.values()], pa.string())], names=PARTIAL.names)

    def more(key, table):
        w = None
        for x in map(json.loads, table.column("wrapper").to_pylist()):
            w = bounded(join(w, x)) if w else x
        return pa.table({"host": pa.array([key[0].as_py()], pa.string()), "part": pa.array([0], pa.int64()), "wrapper": pa.array([json.dumps(w)], pa.string())})

    partial = pages.select(host().alias("host"), "html").mapInArrow(start, PARTIAL)
    halved = partial.groupBy("host", F.pmod("part", F.lit(FIRST_JOIN)).alias("some")).applyInArrow(more, PARTIAL)
    return halved.groupBy("host").applyInArrow(more, PARTIAL).select("host", "wrapper")


def host_rules(wrappers: DataFrame) -> DataFrame:
    schema = T.StructType([T.StructField("host", T.StringType()), T.StructField("rule", T.StringType())])

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array([json.dumps(rules(json.loads(w))) for w in batch.column("wrapper").to_pylist()], pa.string())], names=schema.names)

    return wrappers.mapInArrow(run, schema)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    known = materialise(host_rules(infer(pages)), "rules")
    size = known.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("rule") + 64), F.lit(0))).first()[0]
    rows = pages.select("page_id", "url", "html", host().alias("host"))
    rows = rows.join(F.broadcast(known) if size <= SEND_BYTES else known, "host", "left")
    schema = T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        loaded: dict[str, dict] = {}
        kept = 0
        for batch in batches:
            texts = []
            for page, rule in zip(batch.column("html").to_pylist(), batch.column("rule").to_pylist()):
                if rule is not None and rule not in loaded:
                    kept += len(rule)
                    if kept > KEPT_CHARS:
                        loaded.clear()
                        kept = len(rule)
                    loaded[rule] = json.loads(rule)
                texts.append(extract(page, loaded.get(rule)))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=schema.names)

    return rows.drop("host").mapInArrow(run, schema)
