"""Main text where names mislead, languages are not listed and markup is broken; the two passes against a plain reading of their rules."""

import random
import time

import pytest

from docloom.llm import html_text

BODY = " ".join(["The people of the town said that they were in the house for a long time and it was not what he had to do with it."] * 4)
OTHERS = {
    "cs": "Vláda dnes schválila nový zákon, který mění pravidla podnikání v celé zemi. Odborníci upozorňují, že dopady budou patrné teprve příští rok. " * 2,
    "zh": "政府今天批准了一项新的法律，改变了全国的营商规则。专家指出，影响要到明年该法规第二部分生效时才会显现出来。" * 3,
    "ru": "Сегодня правительство одобрило новый закон, который меняет правила ведения бизнеса по всей стране, сообщили эксперты. " * 3,
}


@pytest.mark.parametrize(
    "page",
    [
        '<div class="layout has-sidebar"><p>{}</p></div>',
        '<div class="no-footer"><div class="wrap"><p>{}</p></div></div>',
        '<div class="col ad-free"><p>{}</p></div>',
        '<div class="post comments-open"><p>{}</p></div>',
        '<form id=aspnetForm><input type=hidden name=v><div><p>{}</p></div></form>',
        '<article><p><a href=x>by one</p><p>{}</p></article>',
        '<div id="sidebar"><p>{}</p></div>',  # what holds all the text is no sidebar
        '<div class="popup"><div class="nav"><a href=/>x</a></div><p>{}</p></div>',
        "<div><p title='a > b'>{}</p></div>",
        "<ul><li><a href=/1>one<li><a href=/2>two</ul><p>{}</p>",
    ],
)
def test_the_text_is_not_lost_to_a_name(page):
    assert BODY in html_text.main_text(f"<html><body>{page.format(BODY)}</body></html>")


@pytest.mark.parametrize("name", ["sidebar", "comment-list", "site-footer", "cookie_banner", "related-posts", "main-nav", "footer__links", "ad ad-box-3", "post-comments"])
def test_unwanted_containers_stay_out(name):
    side = " ".join(["And this is the text of a box that is on the side of the page and not what it is about."] * 6)
    for wrap in ("<div><p>{}</p></div>", "<article><p>{}</p></article>"):
        page = f'<html><body>{wrap.format(BODY)}<div class="{name}"><p>{side}</p></div></body></html>'
        assert html_text.main_text(page) == BODY


@pytest.mark.parametrize("lang", sorted(OTHERS))
def test_languages_without_listed_stop_words(lang):
    text = " ".join(OTHERS[lang].split())
    menu = "".join(f"<li><a href=/{i}>{text[:20]} {i}</a></li>" for i in range(6))
    assert html_text.main_text(f"<html><body><ul>{menu}</ul><div><p>{text}</p></div><ul>{menu}</ul></body></html>") == text


@pytest.mark.parametrize(
    "page",
    [
        "<div>" * 50_000 + "</b2></span2>" * 25_000,
        "<a" * 100_000,
        '<a x="' * 50_000,
        "<a x='y\">" * 30_000,
        '<div class="ad">x' * 50_000,
        "<a href=x><p>t</p>" * 30_000,
        "<div><p></i></div></q>" * 25_000,
        "<" * 200_000,
        "<script>" * 100_000,
        "<script></style>" * 50_000,
        "<!--" * 100_000,
        "<b class=ad>x</i>" * 40_000,
        "<!x" * 100_000,
        "<p>a</p>" * 50_000,
    ],
)
def test_time_grows_with_the_length_alone(page):
    took = []
    for part in (page[: len(page) // 4], page):
        start = time.thread_time()
        html_text.main_text(part)
        took.append(time.thread_time() - start)
    assert took[1] < max(0.5, 9 * took[0]), took  # sixteen times, were it quadratic


def plain_labels(found, unlisted):
    """The rules again, block by block, looking both ways from each."""
    first = []
    for b in found:
        words = html_text.WORD.findall(b.text.lower())
        stops = sum(w in html_text.STOP_WORDS for w in words) / max(len(words), 1)
        inside, links, size = b.region == "article", b.linked / max(len(b.text), 1), len(b.text)
        if links > (0.5 if inside else 0.2):
            first.append("bad")
        elif size < 70:
            first.append("short")
        elif stops >= 0.32 or unlisted:
            first.append("good" if size > 200 or inside else "near")
        else:
            first.append("near" if inside or stops >= 0.30 else "bad")
    out = []
    for i, b in enumerate(found):
        if first[i] in ("good", "bad"):
            out.append(first[i])
            continue
        near = []
        for side in (range(i - 1, -1, -1), range(i + 1, len(found))):
            k = next((k for k in side if first[k] in ("good", "bad")), None)
            if k is not None and found[k].region == b.region:
                near.append(first[k])
        if len(set(near)) == 1:
            out.append(near[0])
        else:
            out.append("good" if b.region == "article" or (near and first[i] == "near") else "bad")
    return out


def test_two_passes_equal_a_plain_reading():
    r = random.Random(12)
    common, rare = ["the", "of", "and", "is", "was", "it"], ["house", "blue", "walk", "seven", "metal", "cloud", "green"]
    for _ in range(400):
        found = []
        for _ in range(r.randint(0, 14)):
            share = r.choice([0, 0.2, 0.31, 0.4, 0.6])
            text = " ".join(r.choice(common if r.random() < share else rare) for _ in range(r.choice([2, 8, 16, 30, 60])))
            found.append(html_text.Block(text, r.choice([0, 0, 0, len(text) // 4, len(text)]), r.choice(["rest", "rest", "article"])))
        long = [b for b in found if len(b.text) >= 70 and b.linked <= 0.2 * len(b.text)]
        words = [w for b in long for w in b.text.split()]
        unlisted = sum(w in html_text.STOP_WORDS for w in words) < html_text.STOP_LEAST * len(words)
        want = plain_labels(found, unlisted)
        assert [b.label for b in html_text.classify(found)] == want
