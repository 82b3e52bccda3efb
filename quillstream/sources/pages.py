"""Posts out of HTML pages: boundaries, one recipe a platform, metadata, nearest links, ad signs and the generic fallback."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.sources.dom import Node, tree

# Elements without content, elements that may hold it, and what marks the boundary of a post.
NOISE = frozenset("script style noscript nav footer header svg form input button select textarea iframe a".split())
CONTENT = frozenset("div article section p li blockquote td figcaption main span".split())
BOUNDARY = ", ".join(
    (
        "div.feed-shared-update-v2", "div.occludable-update", '[data-urn*="urn:li:activity:"]', '[data-urn*="urn:li:share:"]', '[data-urn*="urn:li:ugcPost:"]',
        ".job-card-container", ".jobs-search-results__list-item", ".job-card-list", 'article[data-testid="tweet"]', '[role="article"]', 'div[data-pagelet^="FeedUnit_"]',
        'div[data-pagelet^="ReelsConsumerVideoSheet"]', 'div[data-pagelet^="ReelsUnit"]', 'div[data-pagelet^="Reel_"]', '[data-testid="key__feed_story"]', 'div[data-testid="fbfeed_story"]',
        "ytd-rich-item-renderer", "ytd-video-renderer", "ytd-compact-video-renderer", "ytd-grid-video-renderer", "ytd-reel-video-renderer", "ytd-comment-thread-renderer",
        "article", "div.postArticle", '[class*="post-"]', '[class*="article-"]',
    )
)
POST_CLASS = re.compile(r"\b(post|tweet|article|card|feed-item|story)\b")
LAYOUT_CLASS = re.compile(r"container|list|grid|deck|wrapper|feed|group|scroller|tray|stream|holder|body|page|app|main")
KNOWN = ("youtube.com", "facebook.com", "x.com", "twitter.com", "linkedin.com", "medium.com", "instagram.com")
PERMALINKS = ("/post", "/status", "/p/", "/watch", "/video", "/articles", "/pulse", "/reel", "/jobs/view/", "/jobs/")
PROFILES = ("/in/", "/company/", "/@", "/user/", "/channel/")
BADGES = frozenset({"sponsored", "promoted", "ad", "advertisement"})
AD_CLASSES = ("ad-container", "sponsored-post", "promoted-tweet")
REELS = ("ReelsConsumerVideoSheet", "ReelsUnit", "Reel_")
CONTROLS = ("Follow", "Like", "Comment", "Share")
SHORT, KNOWN_SHORT, LONG, DENSITY = 60, 20, 2000, 0.4
DURATION = re.compile(r"\d{1,2}:\d{2}(:\d{2})?")
PROFILE_PATH = re.compile(r"/[A-Za-z0-9_.]+/?")


def units(text: str) -> int:
    """Length as browsers count it."""
    return len(text.encode("utf-16-le")) // 2


def on(host: str, domains: tuple[str, ...]) -> bool:
    return any(host == d or host.endswith("." + d) for d in domains)


def flat(text: str) -> str:
    return " ".join(text.split())


def text_of(n: Node | None) -> str:
    return n.inner() if n else ""


def usable(href: str | None) -> bool:
    return bool(href) and not href.startswith(("javascript:", "#"))


# --- boundaries ---------------------------------------------------------------------------------------------------
def title_link(n: Node) -> Node | None:
    """The link that names a card: 20 to 180 characters, and not to the page itself, its start, searches or tags."""
    for a in n.all("a[href]"):
        href = a.attrs["href"]
        if usable(href) and href != "/" and "search" not in href and "tag" not in href and 20 <= units(text_of(a)) <= 180:
            return a
    return None


def beside_links(n: Node) -> str:
    """What a card says beside its links, controls and dates."""
    return flat(n.inner(without={id(x) for x in n.all("a[href], button, form, script, style, time, .meta, .comments")}))


def is_card(n: Node) -> bool:
    """A card of a site without a known layout: a link that names it and 15 to 600 characters beside its links."""
    return n.tag in ("div", "article", "section", "li") and title_link(n) is not None and 15 <= units(beside_links(n)) <= 600


def is_post_class(n: Node) -> bool:
    c = n.attrs.get("class", "").lower()
    return bool(POST_CLASS.search(c)) and not LAYOUT_CLASS.search(c)


def _innermost(found: list[Node]) -> list[Node]:
    outer = {id(p) for n in found for p in n.above() if p is not n}
    return [n for n in found if id(n) not in outer]


def boundaries(root: Node, host: str) -> list[Node]:
    """Elements that are posts: by selector, else the nearest of a post's class, else, on unknown sites, the smallest cards."""
    found = root.all(BOUNDARY)
    if not found:
        found = _innermost([n for n in root.walk() if n.tag and is_post_class(n)])
    if not found and not on(host, KNOWN):
        found = _innermost([n for n in root.walk() if n.tag and is_card(n)])
    return found


# --- recipes: the text of a post, or none if the recipe doesn't fit -------------------------------------------------
def _card(n: Node) -> str:
    title, rest = text_of(title_link(n)), beside_links(n)
    return f"{title}\n\n{rest}" if title and units(rest) >= 15 else ""


def _is_profile(a: Node | None) -> bool:
    return a is not None and bool(PROFILE_PATH.fullmatch(a.attrs["href"])) and a.attrs["href"] not in ("/explore/", "/reels/", "/direct/")


def _instagram(n: Node) -> str:
    if n.tag != "article":
        return ""
    name = text_of(next((a for a in n.all("a[href]") if _is_profile(a)), None))
    for x in n.all("span, div, h1, h2, h3") if name else ():
        if len(x.children()) <= 15 and not x.within('header, [class*="head"]') and _is_profile(x.one("a[href]")):
            caption = text_of(x)
            if caption.startswith(name) and units(caption) > units(name) + 4:
                return caption[len(name) :].strip()
    gone = {id(x) for x in n.all('header, button, span[role="button"], ul, a[href*="/liked_by/"], a[href*="/likers/"]')}
    gone |= {id(x) for x in n.all("span, div, p, section, h1, h2, h3") if (t := text_of(x)) == "Follow" or "Suggested for you" in t and units(t) < 40 or re.fullmatch(r"(?i)[\d.,]+[KM]? likes?", t)}
    return flat(n.inner(without=gone, tags=NOISE))


def _medium(n: Node) -> str:
    if n.tag != "article" and "postArticle" not in n.attrs.get("class", "").split():
        return ""
    head = n.one('h2, h3, [data-testid="post-title"]')
    title = text_of(head) if head else n.attrs.get("aria-label", "")
    link = head.within("a") if head else None
    after = (link.sibling(1) if link else None) or (head.sibling(1) if head else None)
    author = next((t for a in n.all('a[href*="/@"]') if (t := text_of(a))), "")
    return flat(f"{title} {text_of(after) if after and after.tag in ('p', 'h3', 'div') else ''} {'By: ' + author if author else ''}") if title else ""


def _linkedin(n: Node) -> str:
    body = text_of(n.one('.update-components-text, [class*="break-words"]'))
    author = text_of(n.one('.update-components-actor__title, span[class*="actor__title"]'))
    about = flat(text_of(n.one('.update-components-actor__description, span[class*="actor__description"]')))
    head = f"Post by: {author}" + (f" ({about})" if about else "") if author else ""
    return "\n\n".join(x for x in (head, body) if x) if body else ""


def _x(n: Node) -> str:
    body = text_of(n.one('[data-testid="tweetText"]'))
    author = flat(text_of(n.one('[data-testid="User-Name"]'))).split("·")[0].strip()
    return "\n\n".join(x for x in (f"Tweet by: {author}" if author else "", body) if x) if body else ""


def _longest(found: list[Node], but: str = "") -> str:
    texts = [t for x in found if (t := text_of(x)) and t != but and not any(w in t for w in CONTROLS)]
    return max(texts, key=units, default="")


_FACEBOOK_AUTHOR = 'h2 strong, h3 strong, h4 strong, span strong, a strong, h2 a[role="link"], h3 a[role="link"], h4 a[role="link"]'


def _facebook(n: Node) -> str:
    if any(r in n.attrs.get("data-pagelet", "") for r in REELS):
        author = text_of(n.one('h2 a[role="link"], h3 a[role="link"], h4 a[role="link"], strong a[role="link"], a[role="link"] strong, span > a[role="link"]')) or "Facebook Reel"
        caption = _longest(n.all('span[dir="auto"], div[dir="auto"]'), author)
        return f"{caption}\n\nAuthor: {author}" if caption else ""
    author = text_of(n.one(_FACEBOOK_AUTHOR))
    body = _longest([x for x in n.all('div[dir="auto"], span[dir="auto"], p') if not x.within('h2, h3, h4, [role="button"], a')])
    return f"Post by: {author}\n\n{body}" if author and units(body) > 10 else ""


def _youtube(n: Node) -> str:
    if n.tag == "ytd-comment-thread-renderer":
        body = n.one("#content-text")
        return f"Comment by {text_of(n.one('#author-text'))}:\n{text_of(body)}" if body else ""
    if not (n.tag.startswith("ytd-") and "video-renderer" in n.tag or n.tag in ("ytd-rich-item-renderer", "ytd-reel-video-renderer")):
        return ""
    title = text_of(n.one("#video-title, #video-title-link, #title, yt-formatted-string.title, .title, .ytd-reel-player-header-renderer"))
    if not title or DURATION.fullmatch(title):
        plain = (a for a in n.all('a[href*="watch?v="]') if "thumbnail" not in a.attrs.get("id", "") + a.attrs.get("class", "") and not a.one("img, ytd-thumbnail, yt-img-shadow"))
        title = next((t for a in plain if (t := text_of(a)) and not DURATION.fullmatch(t)), "")
    channel = text_of(n.one("ytd-channel-name, #channel-name, #byline-container, .channel-name, #channel-name-container")) or next((t for a in n.all('a[href*="/@"], a[href*="/user/"], a[href*="/channel/"]') if (t := text_of(a))), "")
    about = flat(text_of(n.one("#metadata-line, ytd-video-meta-block, .metadata-line, #metadata")))
    return "\n".join(x for x in (title, channel and f"Channel: {channel}", about and f"Info: {about}") if x) if title else ""


RECIPES: tuple[tuple[tuple[str, ...], Callable[[Node], str]], ...] = (
    (("instagram.com",), _instagram), (("medium.com",), _medium), (("linkedin.com",), _linkedin), (("x.com", "twitter.com"), _x), (("facebook.com",), _facebook), (("youtube.com",), _youtube),
)


def post_text(n: Node, host: str) -> str:
    """The text of a post by its platform's recipe, else all its text without noise."""
    recipe = next((r for domains, r in RECIPES if on(host, domains)), _card)
    return recipe(n) or flat(n.inner(tags=NOISE))


# --- metadata -------------------------------------------------------------------------------------------------------
def _first(n: Node, selector: str) -> str:
    a = n.one(selector)
    return a.attrs.get("href", "") if a else ""


def metadata(n: Node, host: str) -> tuple[str, str, str]:
    """(author, author's link, permalink) as the platform marks them, empty where it doesn't."""
    if on(host, ("linkedin.com",)):
        a = n.one('a.update-components-actor__meta-link, a.app-aware-link[href*="/in/"], a.app-aware-link[href*="/company/"]')
        post = _first(n, '.update-components-actor__container a[href*="/posts/"], a[href*="/posts/"], a[href*="/activity/"], a[href*="/feed/update/urn:li:activity:"], a[href*="/jobs/"]')
        return text_of(a).split("\n")[0], a.attrs.get("href", "") if a else "", post
    if on(host, ("x.com", "twitter.com")):
        user = n.one('[data-testid="User-Name"]')
        link = _first(user, "a[href]") if user else ""
        return text_of(user).split("\n")[0] if link else "", link, (_first(user, 'a[href*="/status/"]') if user else "") or _first(n, 'a[href*="/status/"]')
    if on(host, ("youtube.com",)):
        a = n.one('a[href*="/@"], a[href*="/user/"], a[href*="/channel/"]')
        watch = n.all('a[href*="watch?v="]')
        titled = next((w for w in watch if text_of(w) and not w.one("img")), watch[0] if watch else None)
        return text_of(a), a.attrs["href"] if a else "", titled.attrs["href"] if titled else ""
    if on(host, ("facebook.com",)):
        x = n.one(_FACEBOOK_AUTHOR)
        a = x.within("a[href]") if x else None
        return text_of(x), a.attrs["href"] if a else "", _first(n, 'a[href*="/posts/"], a[href*="/videos/"], a[href*="/reel/"]')
    if on(host, ("medium.com", "instagram.com")):
        a = next((a for a in n.all("a[href]") if text_of(a) and ("/@" in a.attrs["href"] or host.endswith("instagram.com") and _is_profile(a))), None)
        return text_of(a), a.attrs["href"] if a else "", ""
    # other sites: what they mark as the author
    x = n.one('[rel="author"], [itemprop="author"], .author, .byline, .username')
    a = x if x is None or x.tag == "a" else x.one("a[href]")
    return text_of(x), a.attrs.get("href", "") if a else "", ""


def nearest_link(n: Node) -> str:
    """A permalink inside; else the link around, or a permalink below an element around; else the first link inside; else one
    of a neighbour; else none."""
    permanent = lambda h: usable(h) and any(p in h for p in PERMALINKS)
    for x in n.above():
        if x is not n or not permanent(next((a.attrs["href"] for a in n.all("a[href]") if permanent(a.attrs["href"])), "")):
            if x.tag == "a" and usable(x.attrs.get("href")) and (permanent(x.attrs["href"]) or not any(p in x.attrs["href"] for p in PROFILES)):
                return x.attrs["href"]
        if x.tag in ("body", "html"):
            break
        if inside := next((a.attrs["href"] for a in x.all("a[href]") if permanent(a.attrs["href"])), ""):
            return inside
    for x in (n, n.sibling(-1), n.sibling(1)):
        if x is not None:
            here = [x] if x.tag == "a" and x is not n else []
            if link := next((a.attrs["href"] for a in [*here, *x.all("a[href]")] if usable(a.attrs.get("href"))), ""):
                return link
    return ""


def is_ad(n: Node) -> bool:
    """The words of an advertisement stand in the text, and an element says nothing else or has them in its class; or the
    post's own class says so."""
    low = n.inner().lower()
    if any(w in low for w in ("sponsored", "promoted", "advertisement")):
        if any(x.inner().strip().lower() in BADGES or "sponsored" in x.attrs.get("class", "") or "promoted" in x.attrs.get("class", "") for x in n.walk() if x is not n):
            return True
    return any(c in n.attrs.get("class", "").lower() for c in AD_CLASSES)


def dense(root: Node) -> list[Node]:
    """Blocks of text on pages without boundaries: long enough, and more text than markup; nothing within noise or within
    a block already taken."""
    out: list[Node] = []
    taken: set[int] = set()
    for n in root.walk():
        if n.tag in CONTENT and not any(id(p) in taken or p.tag in NOISE for p in n.above()):
            size = units(n.inner())
            if SHORT <= size <= LONG and n.size and size / n.size > DENSITY:
                out.append(n)
                taken.add(id(n))
    return out


def extract(html: str | None, url: str | None, known: bool = False) -> list[tuple]:
    """(text, platform, url, author, author url, is ad) of every post of a page; none for an empty page.

    If any boundary stands in the page, only boundaries count; else blocks of dense text do. A text counts once a page.
    """
    if not html or not html.strip():
        return []
    root = tree(html)
    base = url or ""
    host = (urlsplit(base).hostname or "").lower()
    absolute = lambda h: urljoin(base, h) if usable(h) else ""
    found = boundaries(root, host)
    out: dict[str, tuple] = {}
    for n in found or dense(root):
        text = post_text(n, host) if found else n.inner()
        if text in out or found and not (KNOWN_SHORT if known or on(host, KNOWN) else SHORT) <= units(text) <= LONG:
            continue
        name, link, post = metadata(n, host) if found else ("", "", "")
        out[text] = (text, host.removeprefix("www."), absolute(post) or absolute(nearest_link(n)) or base, name, absolute(link), is_ad(n))
    return list(out.values())


def posts_of_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", known: tuple[str, ...] = ()) -> DataFrame:
    """Rows (key, text, sourcePlatform, sourceUrl, authorName, authorUrl, isAd) of the posts of pages; pages stay where they are.

    Posts of the sites `known` may be as short as those of the built-in ones. Null and empty pages give no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, *p) for k, u, h in zip(b["key"], b["url"], b["html"]) for p in extract(h, u, on((urlsplit(u or "").hostname or "").lower(), known))]
            yield pd.DataFrame(rows, columns=["key", "text", "sourcePlatform", "sourceUrl", "authorName", "authorUrl", "isAd"])

    few = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).alias("html"))
    kind = few.schema["key"].dataType.simpleString()
    return few.mapInPandas(run, f"key {kind}, text string, sourcePlatform string, sourceUrl string, authorName string, authorUrl string, isAd boolean").withColumnRenamed("key", key)
