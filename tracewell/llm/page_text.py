"""Main text of web pages by equivalence-class template deduction.

A page is a sequence of tokens: tags and text nodes, each told apart by its path of open elements. Pages of one host come
from one template, so a template's tokens share their occurrence vector: how often they occur in each of the host's
pages. Vectors are folded into 64 bits with a commutative sum as tokens are counted, so a host with a third of all pages
is counted in parts like any other. Classes of two tokens or more that occur in most of a host's pages, and with different
articles, are valid; told apart by their paths they are its template. What lies between is slots. The article element
is the main slot where a page has one; else the deepest template container that holds most of the host's slot text.
Template text is dropped inside the main slot (by whole blocks in an article) as outside, as are regions that by element, role or class are not the
article. Copies of an article share its text as they share a template's: copies count as one page, and an article that
the template would leave little of is kept as it is.
"""

import hashlib
import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .tables import settled

U = np.uint64
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|iframe|textarea|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?][^>]*>|[^<]+|<",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORDS = re.compile(r"[^a-z0-9]+")
# fixed values: HTML's elements by kind
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
ASIDE = set("nav footer aside form menu dialog head".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that a tag's implied end does not reach over.
FENCES = set("article main section div body ul ol table blockquote td th li dl".split())
ENDS_P = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
NOT_MAIN = set(
    "ad ads advert adverts advertisement advertising adbox adsense sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead cookie cookies "
    "consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription share sharing social related recommended comment comments commentlist disqus respond "
    "replies widget toolbar pagination pager login signup complementary contentinfo search".split()
)
#: Words of a class or role that an article's own parts may bear as well: they tell only where the template has the element.
ORDINARY = set("search social related recommended respond alert notice notices notification promo promotion replies comment banner overlay widget menu".split())
#: Ids of readers' comments; inside an article no other id tells.
COMMENT_IDS = {"comments", "commentlist", "disqus_thread", "respond"}
#: Words that no article below makes good: its readers' comments are articles too.
COMMENTS = set("comment comments commentlist disqus respond replies".split())
#: Elements whose ids name what they are about.
NAMED_BY_TOPIC = set("h1 h2 h3 h4 h5 h6 p section li dt dd td th a span".split())
#: Elements whose text is not shown as text, or is a control's.
HIDDEN = set("template svg select button object canvas".split())
#: Elements that hold the whole page, whatever their classes say of it.
WHOLE = {"html", "body"}
WEAK = "weak"
MOST_PAGES, LEAST_PAGES, MAIN_SHARE = 0.5, 3, 0.6
#: Least share of an article's characters that its slots hold, where a host's template is of few pages and where of MANY_PAGES.
FEW_SHARE, MANY_SHARE, MANY_PAGES = 0.5, 0.2, 8
#: Bytes of html that a worker parses before it passes its counts on.
SLICE_BYTES = 1 << 20
#: Hosts up to which the templates are broadcast (about 1 kB each).
BROADCAST_HOSTS = 5000


class Page:
    """Text nodes and containers of one page, in order."""

    def __init__(self, source: str):
        #: (path hash, block number, inside an article or main element, in a region that is not main, text, containers)
        self.texts: list[tuple[int, int, bool, bool, str, tuple[int, ...]]] = []
        self.tags: list[int] = []
        #: Containers inside an article that are of another region if the template has them.
        self.doubtful: set[int] = set()
        self.has_article = False
        stack: list[tuple[str, int, bool, bool]] = []  # element, path hash, article above, not main above
        #: Texts in an article below a region that only a class word tells from the main one; they count if no other article does.
        weak: set[int] = set()
        block = 0
        for m in TOKEN.finditer(source):
            raw, name = m.group(0), m.group(3)
            if m.group(1) or raw.startswith(("<!", "<?")):
                continue
            if name is None:
                text = html.unescape(raw)
                path, article, off = stack[-1][1:] if stack else (0, False, False)
                if off == WEAK and article:
                    weak.add(len(self.texts))
                self.texts.append((path, block, article, bool(off), text, tuple(s[1] for s in stack)))
                continue
            name = name.lower()
            if m.group(2):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        del stack[i:]
                        break
                if name not in INLINE:
                    block += 1
                continue
            if name == "br":
                path, article, off = stack[-1][1:] if stack else (0, False, False)
                if off == WEAK and article:
                    weak.add(len(self.texts))
                self.texts.append((path, block, article, bool(off), " ", ()))
                continue
            if name in HIDDEN:
                if name == "svg" and m.group(4).endswith("/"):
                    continue
                end = re.compile(rf"<(/?){name}\b", re.I).search(source, m.end())
                if end is None or (name in ("button", "select") and not end[1]):
                    continue  # never closed: what follows is not its content
            if name not in INLINE:
                block += 1
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in CLOSES.get(name, ()) or (stack[i][0] == "p" and name in ENDS_P):
                    del stack[i:]
                    break
                if stack[i][0] in FENCES:
                    break
            if name in VOID:
                continue
            path, article, off = stack[-1][1:] if stack else (0, False, False)
            attributes = {k.lower(): (a or b or c).lower() for k, a, b, c in ATTRIBUTE.findall(m.group(4))} if m.group(4) else {}
            named = {w for k, v in attributes.items() if k != "id" for w in WORDS.split(v)}
            ids = attributes.get("id", "")
            if not article and name not in NAMED_BY_TOPIC:
                named |= set(WORDS.split(ids))
            if name in WHOLE:
                named = set()
            told = named & NOT_MAIN - ORDINARY if article else named & NOT_MAIN
            if name in ASIDE or name in HIDDEN or ids in COMMENT_IDS or told & COMMENTS or (article and told) or (not article and name == "header"):
                off = True
            elif not off and (told or (not article and "header" in named)):
                off = WEAK
            if name in ("article", "main") and off is not True:
                self.has_article |= name == "article" and not off
                article = article or name
            if name not in INLINE:
                path = path_hash(f"{path} {name} {attributes.get('class', '')}")
                self.tags.append(path)
                if article and named & ORDINARY:
                    self.doubtful.add(path)
            stack.append((name, path, article, off))
        if weak and not any(t[2] and not t[3] and t[4].strip() for t in self.texts):
            self.texts = [(*t[:3], t[3] and i not in weak, *t[4:]) for i, t in enumerate(self.texts)]
        self.has_main = any(t[2] and not t[3] for t in self.texts) or self.has_article

    def kept(self) -> list[tuple]:
        """The text nodes that are not of another region: the article's, where there is one."""
        return [t for t in self.texts if not t[3] and (t[2] or not self.has_main)]

    def content(self) -> int:
        """64 bits of the text of kept()."""
        text = " ".join(" ".join(t[4] for t in self.kept()).split())
        return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little")

    def main_text(self, constant: set[int], containers: list[tuple[int, int]], support: int) -> str:
        """The slots of the article; without one, of the main container, or all that is not of another region."""
        blocks: dict[int, list[str]] = {}
        here = None
        if not self.has_main and containers:
            own = [(c, t) for t, c in containers if t in set(self.tags)]
            most = max((c for c, _ in own), default=0)
            here = min(((c, t) for c, t in own if c >= MAIN_SHARE * most and c > 0), default=(0, None))[1]
        kept = self.kept()
        aside = self.doubtful & {t for t, _ in containers}
        if aside:
            kept = [t for t in kept if not aside.intersection(t[5])]
        if constant:
            slots = [t for t in kept if text_token(t[0], t[4]) not in constant]
            if self.has_main:
                # by whole blocks: a short piece between inline elements may be like another by chance
                own = {t[1] for t in slots if t[4].strip()}
                slots = [t for t in kept if t[1] in own]
                least = MANY_SHARE if support >= MANY_PAGES else FEW_SHARE
                whole, left = (sum(len(t[4].strip()) for t in ts) for ts in (kept, slots))
                slots = slots if left >= least * whole else kept
            kept = slots
        for _, block, _, _, text, above in kept:
            if here is not None and above and here not in above:
                continue
            blocks.setdefault(block, []).append(text)
        out = (" ".join("".join(parts).split()) for _, parts in sorted(blocks.items()))
        return "\n\n".join(b for b in out if b)

    def tokens(self) -> tuple[Counter, Counter, Counter]:
        """How often each tag and each text node occurs, and the slot text under each container, in characters."""
        texts, chars = Counter(), Counter()
        for path, _, _, off, text, above in self.texts:
            n = len(text.strip())
            if n:
                texts[text_token(path, text)] += 1
                if not off:
                    for c in set(above):
                        chars[c] += n
        return Counter(self.tags), texts, chars


def hash_of(text: str) -> int:
    """64 bits of a short text, alike in every process."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    return int(K.mix(K.prefix(K.BYTE[data])[-1:])[0].view(np.int64)) if len(data) else 0


_paths: dict[str, int] = {}


def path_hash(text: str) -> int:
    """The same, remembered for paths, which recur."""
    if len(text) > 200:
        return hash_of(text)
    known = _paths.get(text)
    if known is None:
        if len(_paths) > 50_000:
            _paths.clear()
        known = _paths[text] = hash_of(text)
    return known


def text_token(path: int, text: str) -> int:
    return hash_of(f"{path} {' '.join(text.split())}")


STATS = "host string, kind int, token long, vector long, support long, total long, chars long, seen long, also long"
STATS_SCHEMA = pa.schema([("host", pa.string()), ("kind", pa.int32())] + [(x, pa.int64()) for x in ("token", "vector", "support", "total", "chars", "seen", "also")])
TEXT = "page_id long, url string, text string, n_chars long"
TEXT_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def counted(part: pa.RecordBatch) -> pa.RecordBatch:
    """What a few pages add to their hosts' token counts."""
    seen: dict[tuple[str, int, int], list[int]] = {}
    for i, (name, text) in enumerate(zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True)):
        page = Page(text or "")
        tags, texts, chars = page.tokens()
        # two marks of the content among 64 each: tokens of few marks occur in copies of few pages
        content = page.content()
        seen_bit, also_bit = 1 << (content & 63), 1 << (content >> 6 & 63)
        # the page stands for itself in the vector by its id and content
        own = hash_of(f"{part.column('page_id')[i].as_py()} {len(text or '')}")
        for kind, counter in ((0, tags), (1, texts)):
            for token, n in counter.items():
                row = seen.setdefault((name, kind, token), [0, 0, 0, 0, 0, 0])
                row[0] ^= (own * (2 * n + 1) + n * K.BASE) & (1 << 64) - 1
                row[1] += 1
                row[2] += n
                row[3] += chars[token] if kind == 0 else 0
                row[4] |= seen_bit
                row[5] |= also_bit
        row = seen.setdefault((name, 2, 0), [0, 0, 0, 0, 0, 0])
        row[1] += 1
    keys, values = list(seen), np.array(list(seen.values()), dtype=object).reshape(-1, 6)
    vector, *marks = (pa.array(values[:, c].astype(U).view(np.int64)) for c in (0, 4, 5))
    columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.int64()), vector]
    return pa.RecordBatch.from_arrays([*columns, *(pa.array(values[:, c].astype(np.int64)) for c in (1, 2, 3)), *marks], schema=STATS_SCHEMA)


def main_text(pages: DataFrame, id_col: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) per row of pages.

    text: the article's blocks in page order without its host's template, joined by two \\n; character references are decoded, white space within a
    block is one space, block ends are trimmed, empty blocks are left out. Empty where there is none, or html is null or
    empty; n_chars counts its code points. Pages whose url is null or has no host share one host; rows that repeat an id
    are taken each; an empty table gives an empty result; other columns are ignored.
    """
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url).cast("string"), r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(source).cast("string").alias("html"), host.alias("host"))

    def count(parts):
        for whole in parts:
            for at, n in K.batches(whole.column("html"), SLICE_BYTES):
                yield counted(whole.slice(at, n))
            K.release()

    stats = base.mapInArrow(count, STATS).groupBy("host", "kind", "token").agg(F.bit_xor("vector").alias("vector"), *[F.sum(c).alias(c) for c in ("support", "total", "chars")], *[F.bit_or(c).alias(c) for c in ("seen", "also")])
    differ = F.greatest(F.bit_count("seen"), F.bit_count("also")) >= LEAST_PAGES
    stats = settled(stats.filter((F.col("kind") == 2) | ((F.col("support") >= LEAST_PAGES) & differ)))
    sizes = stats.filter("kind = 2").select("host", F.col("support").alias("pages"))
    often = stats.filter("kind < 2").join(sizes, "host").filter(F.col("support") > MOST_PAGES * F.col("pages"))
    classes = often.groupBy("host", "vector", "support", "total").agg(F.count("*").alias("size")).filter("size > 1")
    valid = often.join(classes, ["host", "vector", "support", "total"], "left_semi")
    templates = settled(
        valid.groupBy("host").agg(
            F.collect_list(F.when(F.col("kind") == 1, F.col("token"))).alias("constant"),
            F.collect_list(F.when(F.col("kind") == 0, F.struct("token", "chars"))).alias("containers"),
            F.max(F.greatest(F.bit_count("seen"), F.bit_count("also"))).cast("long").alias("support"),
        )
    )
    if templates.count() <= BROADCAST_HOSTS:
        templates = F.broadcast(templates)

    def extract(parts):
        for part in parts:
            for at, n in K.batches(part.column("html"), SLICE_BYTES):
                p = part.slice(at, n)
                texts = []
                for text, constant, containers, support in zip(*(p.column(c).to_pylist() for c in ("html", "constant", "containers", "support")), strict=True):
                    texts.append(Page(text or "").main_text(set(constant or ()), [(c["token"], c["chars"]) for c in containers or ()], support or 0))
                yield pa.RecordBatch.from_arrays([p.column("page_id"), p.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=TEXT_SCHEMA)
            K.release()

    return base.join(templates, "host", "left").select("page_id", "url", "html", "constant", "containers", "support").mapInArrow(extract, TEXT)
