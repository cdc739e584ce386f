"""Small per-document helper: one pass over an HTML text, returning raw facts.

Only what needs the element tree happens here (scopes, nesting, raw text). URL
resolution, counting, clipping and hashing are Column expressions.
"""

from __future__ import annotations

import html as html_text
import json
import codecs
import re

_NAME_END = re.compile(r"[\s/>]|\Z")
_MARK = re.compile(r"[>\"']")
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_RAW_END = {
    name: re.compile(rf"</{name}(?=[\s/>])", re.I)
    for name in ("script", "style", "title", "textarea", "iframe", "xmp", "noembed", "noframes")
}
_VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
_NOISE = frozenset("script style noscript template svg nav header footer aside iframe".split())
_CHROME = frozenset("nav header footer aside".split())
_HEAD_ONLY = frozenset("html head title meta link script style base noscript template".split())
_SELF_CLOSING_PEERS = {"p": ("p",), "li": ("li",), "option": ("option",), "tr": ("tr", "td", "th"),
                       "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SRC = ("src", "data-src", "data-lazy-src", "data-original", "data-echo")
_SRCSET = ("srcset", "data-srcset", "data-lazy-srcset")
_JSON_NOISE = re.compile(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?\*/', re.S)
_JSON_COMMA = re.compile(r'"(?:\\.|[^"\\])*"|,(?=\s*[}\]])', re.S)


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, double, single, bare in _ATTR.findall(text):
        found.setdefault(name.lower(), html_text.unescape(double or single or bare))
    return found


def _srcset_first(value: str | None) -> str | None:
    for part in (value or "").split(","):
        words = part.split()
        if words:
            return words[0]
    return None


def _from_srcset(attrs: dict[str, str]) -> str | None:
    return next(filter(None, (_srcset_first(attrs.get(a)) for a in _SRCSET)), None)


def _image_source(attrs: dict[str, str]) -> str | None:
    direct = next((attrs[a] for a in _SRC if attrs.get(a, "").strip()), None)
    return direct or _from_srcset(attrs)


def _reject_constant(name: str):
    raise ValueError(name)


_DECODER = json.JSONDecoder(parse_constant=_reject_constant)


def _json_roots(text: str):
    """Root values of a JSON-LD block up to the first error; comments and trailing commas are fine."""
    text = _JSON_NOISE.sub(lambda m: m.group() if m.group()[0] == '"' else " ", text)
    text = _JSON_COMMA.sub(lambda m: m.group() if m.group()[0] == '"' else "", text)
    at = 0
    while True:
        while at < len(text) and text[at] in " \t\r\n":
            at += 1
        if at >= len(text):
            return
        try:
            value, at = _DECODER.raw_decode(text, at)
        except (ValueError, RecursionError):
            return
        yield value


def _names(value):
    if isinstance(value, str):
        if value.strip():
            yield value.strip()
    elif isinstance(value, list):
        for item in value:
            yield from _names(item)


def _types(value, depth: int = 0):
    if depth > 8:
        return
    if isinstance(value, dict):
        for key, item in value.items():
            yield from _names(item) if key == "@type" else _types(item, depth + 1)
    elif isinstance(value, list):
        for item in value:
            yield from _types(item, depth + 1)


class _Tags:
    """Finds the tags of a text in one pass: what failed once is remembered, so malformed markup costs no more."""

    def __init__(self, source: str):
        self.source = source
        self.last = {mark: source.rfind(mark) for mark in ">\"'"}
        self.failed: set[int] = set()
        self.mark_from = self.mark_at = self.name_from = self.name_to = -1

    def _first_mark(self, at: int) -> int:
        """The first ">" or quote from ``at``, or -1."""
        if not self.mark_from <= at <= self.mark_at:
            found = _MARK.search(self.source, at)
            self.mark_from, self.mark_at = at, found.start() if found else len(self.source)
        return self.mark_at if self.mark_at < len(self.source) else -1

    def _end(self, at: int) -> int:
        """The first ">" from ``at`` outside quotes, or -1."""
        if at > self.last[">"]:
            return -1
        passed = []
        while (mark := self._first_mark(at)) >= 0 and mark not in self.failed:
            sign = self.source[mark]
            if sign == ">":
                return mark
            passed.append(mark)
            if self.last[sign] == mark:
                break
            at = self.source.find(sign, mark + 1) + 1
        self.failed.update(passed)
        return -1

    def _name_end(self, at: int) -> int:
        if not self.name_from <= at <= self.name_to:
            self.name_from, self.name_to = at, _NAME_END.search(self.source, at).start()
        return self.name_to

    def next(self, at: int) -> tuple[int, int, bool, str | None, str] | None:
        """(start, end, closing, name, attributes) of the next tag from ``at``; a comment or declaration has no name."""
        source = self.source
        while (start := source.find("<", at)) >= 0:
            at = start + 1
            if source.startswith("!--", at):
                end = source.find("-->", at + 3)
                return start, end + 3 if end >= 0 else len(source), False, None, ""
            closing = source.startswith("/", at)
            first = at + closing
            if first < len(source) and source[first].isascii() and source[first].isalpha():
                stop = self._name_end(first)
                end = self._end(stop)
                if end < 0 and 0 <= (quote := self._first_mark(first)) < stop:
                    stop, end = quote, self._end(quote)  # a quote right behind the name opens a value
                if end >= 0:
                    return start, end + 1, closing, source[first:stop], source[stop:end]
            if first > at or source[at : at + 1] in ("!", "?"):
                end = source.find(">", at) if at <= self.last[">"] else -1
                if end >= 0:
                    return start, end + 1, False, None, ""
        return None


def scan(source: str) -> dict:
    """Raw facts of one document; attribute values and texts are not yet normalised."""
    facts = {
        "title": None, "description": None, "h1": [], "h2_count": 0, "heading_levels": [], "base_href": None,
        "canonical_href": None, "links": [], "robots": None, "og": [], "schema_types": [],
        "invalid_schema_blocks": 0, "images_total": 0, "images_no_alt": 0, "images": [], "lang": None,
    }
    schema: dict[str, str] = {}
    item_types: list[str] = []
    preloads: list[str] = []
    late_images: list[tuple[int, list]] = []
    text: list[str] = []
    stack: list[str] = []
    open_count: dict[str, int] = {}
    captures: list[tuple[str, int, int, dict]] = []
    spoken: list[str] = []
    pictures: list[list[str]] = []
    noise = chrome = 0
    in_body = False
    at = 0

    def finish(depth: int) -> None:
        nonlocal noise, chrome
        while len(stack) > depth:
            name = stack.pop()
            open_count[name] -= 1
            noise -= name in _NOISE
            chrome -= name in _CHROME
            if name == "picture":
                pictures.pop()
            while captures and captures[-1][1] > len(stack):
                kind, _, parts, attrs = captures.pop()
                value = "".join(spoken[parts:]).strip()
                if kind == "h1":
                    attrs["slot"].append(value)
                else:
                    attrs["slot"]["text"] = value

    def close_to(name: str) -> None:
        if open_count.get(name):
            depth = len(stack) - 1
            while stack[depth] != name:
                depth -= 1
            finish(depth)

    def add_text(chunk: str) -> None:
        nonlocal in_body
        if not in_body and chunk.strip():
            in_body = True
        if "&" in chunk:
            chunk = html_text.unescape(chunk)
        if captures:
            spoken.append(chunk)
        if in_body and not noise:
            text.append(chunk)

    h1_slots: list[list[str]] = []
    tags = _Tags(source)
    while True:
        tag = tags.next(at)
        if tag is None:
            if at < len(source):
                add_text(source[at:])
            break
        start, end, closing, name, inner = tag
        if start > at:
            add_text(source[at:start])
        at = end
        if name is None:
            continue
        name = name.lower()
        if closing:
            if name not in ("html", "body"):
                close_to(name)
            continue
        attrs = _attributes(inner) if inner else {}

        if name == "html":
            if facts["lang"] is None and "lang" in attrs:
                facts["lang"] = attrs["lang"].strip()
            continue
        if name == "body":
            in_body = True
        if attrs.get("itemtype", "").strip():
            item_types.append(attrs["itemtype"])

        if name in _RAW_END:
            end = _RAW_END[name].search(source, at)
            raw = source[at:end.start()] if end else source[at:]
            at = source.find(">", end.start()) + 1 or len(source) if end else len(source)
            if name == "title" and facts["title"] is None:
                facts["title"] = html_text.unescape(raw).strip()
            elif name == "script" and attrs.get("type") == "application/ld+json" and raw.strip():
                roots = 0
                for root in _json_roots(raw):
                    roots += 1
                    for found in _types(root):
                        schema.setdefault(found.upper(), found)
                facts["invalid_schema_blocks"] += roots != 1
            elif name == "textarea":
                in_body = True
                add_text(raw)
            continue

        if name not in _HEAD_ONLY:
            in_body = True

        if name == "meta":
            if attrs.get("name") == "description" and facts["description"] is None:
                facts["description"] = attrs.get("content", "").strip() if "content" in attrs else None
            elif attrs.get("name") == "robots" and facts["robots"] is None:
                facts["robots"] = attrs.get("content")
            if attrs.get("property", "").startswith("og:"):
                facts["og"].append((attrs["property"], attrs.get("content")))
        elif name == "base":
            if facts["base_href"] is None and "href" in attrs:
                facts["base_href"] = attrs["href"]
        elif name == "link":
            rel = attrs.get("rel", "")
            if rel == "canonical" and facts["canonical_href"] is None:
                facts["canonical_href"] = attrs.get("href")
            if "preload" in rel.split() and attrs.get("as") == "image":
                preloads.append(attrs["href"] if "href" in attrs else _srcset_first(attrs.get("imagesrcset")))
        elif name == "img":
            facts["images_total"] += 1
            facts["images_no_alt"] += not attrs.get("alt", "").strip()
            own = _image_source(attrs)
            facts["images"].append(own)
            if own is None and pictures:
                late_images.append((len(facts["images"]) - 1, pictures[-1]))
        elif name == "source":
            if pictures and (candidate := _from_srcset(attrs)):
                pictures[-1].append(candidate)

        if name in _VOID:
            continue
        if name == "a":
            close_to("a")
        peers = _SELF_CLOSING_PEERS.get(name)
        if peers:
            while stack and stack[-1] in peers:
                finish(len(stack) - 1)
        if name in _HEADINGS and stack and stack[-1] in _HEADINGS:
            finish(len(stack) - 1)  # a heading right inside a heading ends it
        if name == "h2":
            facts["h2_count"] += 1
        if name in _HEADINGS and not chrome:
            facts["heading_levels"].append(int(name[1]))

        stack.append(name)
        open_count[name] = open_count.get(name, 0) + 1
        noise += name in _NOISE
        chrome += name in _CHROME
        if name == "picture":
            pictures.append([])
        elif name == "h1":
            slot: list[str] = []
            h1_slots.append(slot)
            captures.append(("h1", len(stack), len(spoken), {"slot": slot}))
        elif name == "a" and "href" in attrs:
            link = {"href": attrs["href"], "text": "", "rel": attrs.get("rel", "")}
            facts["links"].append(link)
            captures.append(("a", len(stack), len(spoken), {"slot": link}))
    finish(0)

    for position, sources in late_images:
        facts["images"][position] = sources[0] if sources else None
    for value in item_types:
        name = value.rstrip("/").split("/")[-1]
        if name.strip():
            schema.setdefault(name.upper(), name)
    facts["h1"] = [slot[0] for slot in h1_slots if slot and slot[0]]
    facts["images"] = [i for i in facts["images"] + preloads if i]
    facts["schema_types"] = [schema[k] for k in sorted(schema)]
    facts["main_text"] = " ".join("".join(text).split())
    return facts


_CHARSET = re.compile(r"charset\s*=\s*[\"']?\s*([^\"';\s/>]+)", re.I)


# Families of the character sets that pages are written in, as codecs name them.
_FAMILIES = ("ascii", "utf", "iso8859", "iso2022_jp", "cp125", "cp866", "cp874", "cp949", "cp932", "cp950", "koi8", "mac", "gb", "big5", "euc", "shift_jis", "tis_620", "johab")


def web_charset(name: str) -> str:
    """The codec of a declared character set; UTF-8 where it is none that pages are written in."""
    try:
        own = codecs.lookup(name.strip()).name.replace("-", "_")
    except (LookupError, ValueError):
        return "utf-8"
    return own if own.startswith(_FAMILIES) and own != "utf_7" else "utf-8"


def decode(body: bytes, content_type: str | None) -> str:
    """Text of a raw body: header charset, else BOM, else the first meta tag with one, else UTF-8."""
    declared = _CHARSET.search(content_type or "")
    name = declared.group(1) if declared else None
    if name is None:
        for bom, charset in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
            if body.startswith(bom):
                name = charset
                break
    if name is None:
        head = body[: body.rfind(b">") + 1]  # every tag in it ends, so no search runs on
        metas = (re.search(rb"charset\s*=\s*[\"']?\s*([^\"';\s/>]+)", m.group(1), re.I) for m in re.finditer(rb"<meta\b([^>]*)>", head, re.I))
        meta = next(filter(None, metas), None)
        name = meta.group(1).decode("ascii", "replace") if meta else "utf-8"
    return body.decode(web_charset(name), errors="replace").lstrip("\ufeff")
