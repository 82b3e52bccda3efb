"""Pages of our own for every platform, and the rules that all share."""

from quillstream.sources import pages
from quillstream.sources.dom import tree


def one(html, url):
    found = pages.extract(html, url)
    assert len(found) == 1, found
    return found[0]


def test_youtube_video_and_comment():
    html = """<ytd-video-renderer><a id="thumbnail" href="/watch?v=a1">4:05</a><a id="video-title" href="/watch?v=a1">Tides explained with a bucket and a lamp</a>
    <ytd-channel-name><a href="/@bucketlab">Bucket Lab</a></ytd-channel-name><div id="metadata-line"><span>12K views</span> <span>3 days ago</span></div></ytd-video-renderer>"""
    text, platform, url, author, link, ad = one(html, "https://www.youtube.com/results")
    assert text == "Tides explained with a bucket and a lamp\nChannel: Bucket Lab\nInfo: 12K views 3 days ago"
    assert (platform, url, author, link, ad) == ("youtube.com", "https://www.youtube.com/watch?v=a1", "Bucket Lab", "https://www.youtube.com/@bucketlab", False)
    comment = '<ytd-comment-thread-renderer><span id="author-text">@mole</span><div id="content-text">The lamp was the best part of this</div></ytd-comment-thread-renderer>'
    assert one(comment, "https://www.youtube.com/watch?v=a1")[0] == "Comment by @mole:\nThe lamp was the best part of this"


def test_x():
    html = """<article data-testid="tweet"><div data-testid="User-Name"><div><a href="/olaf">Olaf Berg</a></div><div>@olaf</div><span>·</span><a href="/olaf/status/77">2h</a></div>
    <div data-testid="tweetText">The ferry was late again and nobody minded at all.</div></article>"""
    text, platform, url, author, link, _ = one(html, "https://x.com/home")
    assert text == "Tweet by: Olaf Berg @olaf\n\nThe ferry was late again and nobody minded at all."
    assert (platform, url, author, link) == ("x.com", "https://x.com/olaf/status/77", "Olaf Berg", "https://x.com/olaf")


def test_linkedin():
    html = """<div class="feed-shared-update-v2"><a class="update-components-actor__meta-link" href="/in/ida-noor/"><span class="update-components-actor__title">Ida Noor</span></a>
    <span class="update-components-actor__description">Bridge engineer</span><div class="update-components-text">We opened the second span today.</div><a href="/posts/ida-9">link</a></div>"""
    text, _, url, author, link, _ = one(html, "https://www.linkedin.com/feed/")
    assert text == "Post by: Ida Noor (Bridge engineer)\n\nWe opened the second span today."
    assert (url, author, link) == ("https://www.linkedin.com/posts/ida-9", "Ida Noor", "https://www.linkedin.com/in/ida-noor/")


def test_facebook_post_reel_and_ad():
    html = """<div role="article"><h3><a role="link" href="/tess.w"><strong>Tess W.</strong></a></h3><div dir="auto">The library keeps its lights on until nine from Monday on.</div>
    <div role="button">Like</div><a href="/tess.w/posts/5">5 h</a></div>"""
    text, _, url, author, link, ad = one(html, "https://www.facebook.com/")
    assert text == "Post by: Tess W.\n\nThe library keeps its lights on until nine from Monday on."
    assert (url, author, link, ad) == ("https://www.facebook.com/tess.w/posts/5", "Tess W.", "https://www.facebook.com/tess.w", False)
    reel = '<div data-pagelet="Reel_1"><span><a role="link" href="/kim">Kim</a></span><span dir="auto">Three ways to fold a paper crane</span></div>'
    assert one(reel, "https://www.facebook.com/reel/1")[0] == "Three ways to fold a paper crane\n\nAuthor: Kim"
    ad = html.replace("</h3>", "</h3><span>Sponsored</span>")
    assert one(ad, "https://www.facebook.com/")[5] is True


def test_medium():
    html = """<article><a href="/@rosa">Rosa Lind</a><a href="/@rosa/bread-1"><h2>Bread without hurry</h2></a><p>What a cold kitchen teaches</p></article>"""
    text, _, _, author, link, _ = one(html, "https://medium.com/")
    assert text.startswith("Bread without hurry") and text.endswith("By: Rosa Lind")
    assert "cold kitchen" in text and author == "Rosa Lind" and link.endswith("/@rosa")


def test_instagram():
    html = """<article><header><a href="/tea.house/">tea.house</a><button>Follow</button><span>Suggested for you</span></header>
    <div><span><a href="/tea.house/">tea.house</a> First flush has arrived, come by this week</span></div><a href="/p/Xy1/">1 h</a><span>2.1K likes</span></article>"""
    text, _, url, author, _, _ = one(html, "https://www.instagram.com/")
    assert text == "First flush has arrived, come by this week"
    assert url == "https://www.instagram.com/p/Xy1/" and author == "tea.house"


def test_cards_of_other_sites():
    links = "".join(f'<a href="#{k}">{k}</a>' for k in range(6))
    html = f"""<div class="row"><div>{links}<a href="/phones/review-12.html">A small phone that lasts two days</a><span>Our testers used it for a month and liked the weight.</span></div></div>"""
    text, platform, url, *_ = one(html, "https://www.gadgets.example/news")
    assert text == "A small phone that lasts two days\n\nOur testers used it for a month and liked the weight."
    assert (platform, url) == ("gadgets.example", "https://www.gadgets.example/phones/review-12.html")


def test_layout_classes_are_no_boundaries_and_dense_text_is_the_fallback():
    assert not pages.is_post_class(tree('<div class="post list"></div>').children()[0])
    assert pages.is_post_class(tree('<div class="big story"></div>').children()[0])
    long = "A plain paragraph without any marks of a post, long enough to be read on its own."
    assert [p[0] for p in pages.extract(f"<main><p>{long}</p></main>", "https://plain.example/")] == [long]
    assert pages.extract(f'<p><i data-x="{"y" * 400}">{long}</i></p>', "https://plain.example/") == []
    assert pages.extract(f"<nav><p>{long}</p></nav>", "https://plain.example/") == []


def test_nearest_link():
    page = tree('<section><a href="/in/me">me</a><a href="/post/1">x</a><div id="d"><a href="/@me">me</a></div></section>')
    assert pages.nearest_link(page.one("#d")) == "/post/1"
    page = tree('<section><a href="/other">o</a><div id="d">text</div></section>')
    assert pages.nearest_link(page.one("#d")) == "/other"
    assert pages.nearest_link(tree('<a href="/story"><div id="d">t</div></a>').one("#d")) == "/story"


def test_broken_and_empty_pages():
    assert pages.extract(None, "https://x.com/") == [] and pages.extract("  ", None) == []
    assert pages.extract("<div><article>" + "never closed text " * 5, None)[0][1] == ""
