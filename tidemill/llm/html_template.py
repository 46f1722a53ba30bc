"""Main text of web pages by deducing the template of their host.

Tokens are opening tags with their place in the page (names and classes of the
enclosing elements). Tokens of a host that occur equally often on every one of
its pages have equal occurrence vectors and form an equivalence class. Only what
is frequent (on ``support`` of the host's distinct pages) can be template. A
second reading of the pages tells which classes are valid:

- ordered: on all pages the tokens come in rounds of one and the same order. A
  class that is not is broken into pairs of a token and its parent, and a pair is
  kept where the two take turns;
- nested: a token whose parent is in another, ordered class always comes after
  the same token of that class.

The template is made of the valid tokens whose enclosing elements are all valid.
Text between its tags fills slots. A slot with one and the same text on all pages
that have it, three at least, is template as well, and so boilerplate, unless an
``article`` or ``main`` holds it.

Slots are then told apart once per host: the main slot is the deepest section of
the template that holds nearly all words, outside links and constant slots, of the
pages that have it. What lies below a navigation, header, footer, advert, form,
notice or comment element is boilerplate. Names come second: a valid ``article`` or
``main`` within that section, or around it, says more closely where the text is; one
elsewhere, such as a teaser, says nothing. A page's text is what its main slot
holds, and the body's where it has none.

An occurrence vector is kept as the exclusive-or of a hash of (page, count) over
the pages, so vectors are merged map-side and a host with a third of all pages
is no larger a group than another. Exact copies of a page count once.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter, defaultdict

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, staged

# Elements of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe template svg math object select option button".split())
BLOCK = set(
    "address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
BOILER = set("nav header footer aside form menu dialog head".split())
#: Elements that can be a host's main slot; the other blocks are parts of a text.
SECTIONS = set("article body center div html main section td".split())
#: A text is constant if so many distinct pages have it.
CONSTANT_PAGES = 3
#: An opening tag of the key's kind closes an open element of these kinds.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
CLOSE_P = BLOCK - {"br", "body", "html", "td", "th", "tr", "tbody", "thead", "tfoot"}
#: Parts of class and id names that mark what is not the article.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|sidebar|side|menu|nav\w*|breadcrumbs?|header|masthead|footer|"
    r"cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|newsletter|subscribe\w*|signup|login|"
    r"comments?|replies|reply|respond|discussion|disqus|social|share|sharing|related|recommended|widget|toolbar|"
    r"search|pagination|pager|copyright|legal|skip)(?:$|[\s_-])",
    re.I,
)
ROLES = re.compile(r"^(?:navigation|banner|contentinfo|complementary|search|form|alert|dialog|menu|menubar)$", re.I)
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTR = re.compile(r"(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)


def _signature(name: str, attrs: str) -> tuple[str, bool]:
    """A token's own part (name and class) and whether its attributes mark boilerplate."""
    if not attrs:
        return name, name in BOILER
    cls, bad = "", name in BOILER
    for m in ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "class":
            cls = re.sub(r"\d+", "0", value.strip())
        if key in ("class", "id") and name not in ("html", "body", "article", "main") and MARKS.search(value):
            bad = True
        if key == "role" and ROLES.match(value) or key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            bad = True
    return f"{name}.{cls}" if cls else name, bad


def walk(page: str):
    """Events of a page in order: ("tag", path, boiler) and ("text", path, text, boiler, in_link), ("break",).

    A tolerant reader: unknown end tags are ignored, an end tag closes what is
    open inside its element, block elements close an open paragraph.
    """
    stack: list[tuple[str, str, bool]] = []  # name, path, below boilerplate
    at, end = 0, len(page)
    while at < end:
        m = TAG.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            top = stack[-1] if stack else ("", "", False)
            yield "text", top[1], page[at:stop], top[2], any(s[0] == "a" for s in stack)
        if not m:
            return
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                yield "text", stack[-1][1] if stack else "", m[0][9:].removesuffix("]]>"), bool(stack and stack[-1][2]), False
            continue
        name = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            if name in BLOCK:
                yield ("break",)
            continue
        if name in BLOCK:
            yield ("break",)
        if name in RAW:
            closing = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            if closing is None and name not in ("script", "style", "textarea", "title"):
                continue
            at = closing.end() if closing else end
            continue
        gone = CLOSES.get(name, ())
        if name in CLOSE_P or gone:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p" and name in CLOSE_P or stack[k][0] in gone:
                    del stack[k:]
                    break
                if stack[k][0] in BLOCK:
                    break
        own, bad = _signature(name, m[3])
        parent = stack[-1] if stack else ("", "", False)
        path = f"{parent[1]}/{own}"
        bad = bad or parent[2]
        if name == "header" and "/article" in parent[1] and not parent[2]:
            bad = False  # the article's own heading
            path = f"{parent[1]}/{own}"
        yield "tag", path, bad
        if name not in VOID and not m[3].rstrip().endswith("/"):
            stack.append((name, path, bad))


def host_of(column):
    return F.lower(F.coalesce(F.regexp_extract(column, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@]*@)?([^/:?#]*)", 1), F.lit("")))


def _structural(path: str) -> bool:
    return path.rsplit("/", 1)[-1].split(".")[0] in BLOCK


def _slot(path: str) -> str:
    """The token that a place's text belongs to."""
    while path and not _structural(path):
        path = path.rpartition("/")[0]
    return path


def _parent(path: str) -> str:
    return _slot(path.rpartition("/")[0])


def _counts(frames):
    """Occurrence vectors of a batch, merged per host: (host, path, vector, pages, uses, words, reach, own, texts, low, high, boiler).

    ``words`` are those below the token, at any depth, ``own`` those in its slot
    itself, and ``reach`` all those of the pages that have it; all outside links and
    boilerplate. ``low`` and ``high`` are the extreme hashes of its slot's texts,
    of which there are ``texts``.
    """
    for pdf in frames:
        vector, pages, uses = defaultdict(int), Counter(), Counter()
        words, reach, own, boiler = Counter(), Counter(), Counter(), set()
        texts, low, high = Counter(), {}, {}
        for host, page in zip(pdf["host"], pdf["html"], strict=True):
            if not page:
                continue
            h = xxhash.xxh64_intdigest(page.encode("utf-8", "surrogatepass"))
            seen: Counter[str] = Counter()
            direct: Counter[str] = Counter()
            filled = defaultdict(list)
            for e in walk(page):
                if e[0] == "tag" and _structural(e[1]):
                    seen[e[1]] += 1
                    if e[2]:
                        boiler.add((host, e[1]))
                elif e[0] == "text" and not e[3] and (said := e[2].split()):
                    slot = _slot(e[1])
                    filled[slot] += said
                    if not e[4]:
                        direct[slot] += len(said)
            for slot, said in filled.items():
                key = host, slot
                digest = xxhash.xxh64_intdigest(" ".join(said).encode("utf-8", "surrogatepass")) - (1 << 63)
                texts[key] += 1
                low[key], high[key] = min(digest, low.get(key, digest)), max(digest, high.get(key, digest))
            for slot, n in direct.items():
                own[host, slot] += n
                for path in (slot, *_ancestors(slot)):
                    if path in seen:
                        words[host, path] += n
            everything = sum(direct.values())
            for path, n in seen.items():
                uses[host, path] += n
                reach[host, path] += everything
                vector[host, path] ^= xxhash.xxh64_intdigest(b"%d %d" % (h, n))
                pages[host, path] += 1
            pages[host, ""] += 1
        if not pages:
            continue
        keys = list(pages)
        yield pd.DataFrame(
            {
                "host": [k[0] for k in keys],
                "path": [k[1] for k in keys],
                "vector": [(vector[k] ^ (1 << 63)) - (1 << 63) if vector[k] < 1 << 64 else 0 for k in keys],
                "pages": [pages[k] for k in keys],
                "uses": [uses[k] for k in keys],
                "words": [words[k] for k in keys],
                "reach": [reach[k] for k in keys],
                "own": [own[k] for k in keys],
                "texts": [texts[k] for k in keys],
                "low": [low.get(k, 0) for k in keys],
                "high": [high.get(k, 0) for k in keys],
                "boiler": [k in boiler for k in keys],
            }
        )


def _numbered(tokens) -> list[tuple[str, int]]:
    """(path, class) of a host's frequent tokens, sorted by path; equal occurrence vectors are one class."""
    numbers: dict[tuple, int] = {}
    return [
        (t["path"], numbers.setdefault((t["vector"], t["pages"]), len(numbers)))
        for t in sorted(tokens, key=lambda t: t["path"])
        if t["path"]
    ]


def _plans(frames):
    """(host, plan) with the numbered tokens of a host as JSON."""
    for pdf in frames:
        yield pd.DataFrame({"host": pdf["host"], "plan": [json.dumps(_numbered(t)) for t in pdf["tokens"]]})


#: Kinds of observations: a class' order, a token and its parent taking turns, a token's place in its parent's class.
ORDER, PAIR, PLACE = 0, 1, 2


def observed(page: str, numbered: list[tuple[str, int]]):
    """(kind, class or token, value or None) of a page; None: against the rules, whatever other pages have."""
    at = {path: i for i, (path, _) in enumerate(numbered)}
    group = [k for _, k in numbered]
    size = Counter(group)
    above = [at.get(_parent(path), -1) for path, _ in numbered]
    runs, last = defaultdict(list), {}
    for e in walk(page):
        if e[0] != "tag" or (i := at.get(e[1])) is None:
            continue
        if above[i] >= 0 and group[above[i]] != group[i]:
            yield PLACE, i, last[group[above[i]]]
        last[group[i]] = i
        runs[group[i]].append(i)
    for k, run in runs.items():
        turn = run[: size[k]]
        good = len(set(turn)) == size[k] and run == turn * (len(run) // size[k])
        yield ORDER, k, xxhash.xxh64_intdigest(repr(turn)) - (1 << 63) if good else None
        if len(run) > size[k]:
            for i in set(run):
                if above[i] >= 0 and group[above[i]] == k:
                    pair = [j for j in run if j in (i, above[i])]
                    if pair != [above[i], i] * (len(pair) // 2):
                        yield PAIR, i, None


def _observations(frames):
    """(host, kind, item, low, high, good) of a batch."""
    for pdf in frames:
        plans: dict[str, list] = {}
        low, high, good = {}, {}, {}
        for host, page, plan in zip(pdf["host"], pdf["html"], pdf["plan"], strict=True):
            if host not in plans:
                plans[host] = json.loads(plan)
            for kind, item, value in observed(page, plans[host]):
                key = host, kind, item
                good[key] = good.get(key, True) and value is not None
                value = value or 0
                low[key], high[key] = min(value, low.get(key, value)), max(value, high.get(key, value))
        if not good:
            continue
        yield pd.DataFrame(
            {
                "host": [k[0] for k in good],
                "kind": [k[1] for k in good],
                "item": [k[2] for k in good],
                "low": list(low.values()),
                "high": list(high.values()),
                "good": list(good.values()),
            }
        )


def valid_tokens(numbered: list[tuple[str, int]], broken: set[tuple[int, int]]) -> set[str]:
    """Paths of the template, of the numbered tokens and the (kind, item) that some page is against."""
    at = {path: i for i, (path, _) in enumerate(numbered)}
    valid: set[str] = set()
    for path, k in numbered:  # parents come before what is below them
        up = _parent(path)
        if up:
            if up not in valid:
                continue
            other = numbered[at[up]][1]
            if other != k and (ORDER, other) not in broken and (PLACE, at[path]) in broken:
                continue
            if other == k and (ORDER, k) in broken and (PAIR, at[path]) in broken:
                continue
        valid.add(path)
    return valid


def _template(nearly: float = 0.9):
    def build(tokens, broken: set[tuple[int, int]]) -> dict[str, list[str]]:
        """Main slots and constant slots of a host from its tokens (as of _counts)."""
        rows = {t["path"]: t for t in tokens if t["path"]}
        valid = valid_tokens(_numbered(tokens), broken)
        constant = {
            p: t["own"] / t["pages"]
            for p, t in rows.items()
            if p in valid and t["texts"] == t["pages"] >= CONSTANT_PAGES and t["low"] == t["high"] and not _of_article(p + "/")
        }
        out = {"slots": [], "constant": sorted(constant)}

        def holds(p: str) -> bool:
            t = rows[p]
            words, reach = t["words"], t["reach"]
            for c, n in constant.items():
                if (c + "/").startswith(p + "/"):
                    words, reach = words - n * rows[c]["pages"], reach - n * rows[c]["pages"]
                else:
                    reach -= n * min(rows[c]["pages"], t["pages"])
            return words > 0 and words >= nearly * reach

        # the deepest section, once on a page, with nearly all varying words of its pages below it
        kind = lambda p: p.rsplit("/", 1)[-1].split(".")[0]
        inside = [p for p in valid if kind(p) in SECTIONS and rows[p]["uses"] == rows[p]["pages"] and holds(p)]
        best = max(inside, key=lambda p: (p.count("/"), rows[p]["words"], p), default=None)
        # its name may say more closely where the article is: within that section, or just around it
        near = lambda p: best is None or (p + "/").startswith(best + "/") or (best + "/").startswith(p + "/")
        named = [p for p in valid if kind(p) in ("article", "main") and not rows[p]["boiler"] and near(p)]
        named = [p for p in named if kind(p) == "article"] or named
        if named:
            out["slots"] = sorted(p for p in named if not any(p.startswith(q + "/") for q in named))
        elif best and not any(kind(p) in ("article", "main") and not t["boiler"] and near(p) for p, t in rows.items()):
            out["slots"] = [best]  # else the page's own article is read by its name
        return out

    def of_hosts(frames):
        for pdf in frames:
            built = [
                build(t, {(b["kind"], b["item"]) for b in broken} if broken is not None else set())
                for t, broken in zip(pdf["tokens"], pdf["broken"], strict=True)
            ]
            yield pd.DataFrame({"host": pdf["host"], "slots": [json.dumps(b) for b in built]})

    return of_hosts


def _of_article(path: str) -> bool:
    return "/article/" in path or "/main/" in path or "/article." in path or "/main." in path


def _ancestors(path: str):
    while path := path.rpartition("/")[0]:
        yield path


def main_text(page: str, slots: list[str], constant: list[str] = ()) -> str:
    """Text of the main slots; of a page that has none of them, of its article or main, else of its body.

    Constant slots outside articles are left out, unless the page has nothing else.
    """
    found: dict[str, list[str]] = {"slot": [], "article": [], "body": [], "constant": []}
    parts: dict[str, list[str]] = {k: [] for k in found}

    def flush():
        for k, p in parts.items():
            if p:
                if text := " ".join(entities.unescape("".join(p)).split()):
                    found[k].append(text)
                p.clear()

    below, constant = tuple(s + "/" for s in slots), set(constant)
    for e in walk(page):
        if e[0] == "break":
            flush()
        elif e[0] == "text" and not e[3]:
            path = e[1] + "/"
            if constant and _slot(e[1]) in constant:
                parts["constant"].append(e[2])
            elif below and path.startswith(below):
                parts["slot"].append(e[2])
            elif _of_article(path):
                parts["article"].append(e[2])
            else:
                parts["body"].append(e[2])
    flush()
    return "\n".join(next((v for v in found.values() if v), []))


def extract_main_text(pages: DataFrame, support: float = 0.6) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html; others are ignored).

    Character references are decoded, white space inside a block becomes one
    space, blocks are joined by a line break. A null or empty html, or one without
    text in its main slot, gives an empty text. A null url has the empty host.
    Repeated rows give repeated results; an empty table an empty result.
    """
    bounded_batches(pages.sparkSession)
    base = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    distinct = base.select("host", "html", F.xxhash64("html").alias("h"), F.md5("html").alias("m")).where("length(html) > 0")
    counted = distinct.dropDuplicates(["host", "h", "m"]).select("host", "html").mapInPandas(
        _counts,
        "host string, path string, vector long, pages long, uses long, words long, reach long, own long, texts long, "
        "low long, high long, boiler boolean",
    )
    tokens = counted.groupBy("host", "path").agg(
        F.bit_xor("vector").alias("vector"),
        *[F.sum(c).alias(c) for c in ("pages", "uses", "words", "reach", "own", "texts")],
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.max("boiler").alias("boiler"),
    )
    # only what is on enough pages can be template: at most a page's tokens / support for a host, however many pages it has
    tokens = staged(tokens, "tokens")
    totals = tokens.where("path = ''").select("host", F.col("pages").alias("total"))
    tokens = tokens.join(totals, "host").where((F.col("pages") >= support * F.col("total")) | (F.col("path") == "")).drop("total")
    fields = F.struct("path", "vector", "pages", "uses", "words", "reach", "own", "texts", "low", "high", "boiler")
    hosts = staged(tokens.groupBy("host").agg(F.collect_list(fields).alias("tokens")), "hosts")
    plans = hosts.mapInPandas(_plans, "host string, plan string")
    # which classes keep order and nesting; copies of a page change nothing here
    seen = base.where("length(html) > 0").join(plans, "host").select("host", "html", "plan")
    broken = (
        seen.mapInPandas(_observations, "host string, kind int, item int, low long, high long, good boolean")
        .groupBy("host", "kind", "item")
        .agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("good").alias("good"))
        .where("not good or low <> high")
        .groupBy("host")
        .agg(F.collect_list(F.struct("kind", "item")).alias("broken"))
    )
    templates = staged(hosts.join(broken, "host", "left").mapInPandas(_template(), "host string, slots string"), "templates")

    def extract(frames):
        for pdf in frames:
            text = [main_text(page, **json.loads(s)) if page else "" for page, s in zip(pdf["html"], pdf["slots"], strict=True)]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": text, "n_chars": [len(t) for t in text]})

    kind = base.schema["page_id"].dataType.simpleString()
    return base.join(templates, "host", "left").select("page_id", "url", "html", "slots").mapInPandas(
        extract, f"page_id {kind}, url string, text string, n_chars long"
    )


def op8_html_template(spark, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
