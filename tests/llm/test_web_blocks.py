"""Made-up pages with known text: comments as articles, sidebars, names that only hold a word, pages without an article, six languages."""

import pytest

from lumenkg.llm.html_extract import main_text

EN = "The cat is in the house and it was on the mat, which is what we have for you in this one and that is all there is to it in the end."
TEXTS = {
    "en": EN + " " + EN,
    "de": "Die Katze ist in dem Haus und sie war auf der Matte, das ist was wir für euch in dem Buch haben, und das ist auch alles, was es zu sagen gibt. " * 2,
    "fr": "Le chat est dans la maison et il est sur le tapis, ce qui est tout ce que nous avons pour vous dans ce livre et ce que je dis à la fin. " * 2,
    "es": "El gato está en la casa y es que la casa es de los que no la ven, y por eso lo que se dice en el libro es para los más que son de la casa. " * 2,
    "it": "Il gatto dorme nella casa mentre fuori piove forte, quindi nessuno degli abitanti vuole uscire prima che torni finalmente sereno sopra tutte le colline della valle. " * 2,
    "zh": "猫在房子里睡觉，外面下着大雨，所以没有人愿意在天晴之前出门，山谷里的居民都在等待太阳重新照耀在田野和村庄之上。" * 5,
    "pl": "Kot spał w domu, podczas gdy na dworze mocno padało, więc nikt z mieszkańców doliny nie chciał wychodzić przed końcem tej długiej wiosennej ulewy. " * 2,
}
TEXTS = {k: v.strip() for k, v in TEXTS.items()}
JUNK = [
    "<section id=comments><ol><li><article class='comment-body'><p>{c}</p></article></ol></section>",
    "<div class=comments><article><p>{c}</p></article></div>",
    "<div id=sidebar><article><p>{c}</p></article></div>",
    "<form action=x><article><p>{c}</p></article></form>",
    "<div class=related><article class=teaser><p>{c}</p></article></div>",
    "<aside><article><p>{c}</p></article></aside>",
    "<article class='comment depth-1'><p>{c}</p></article>",
    "<div class='ad-slot'><p>{c}</p></div>",
    "<div class='cookie-banner'><p>{c}</p></div>",
    "<p><a href=x>{c}</a></p>",
]
COMMENT = "I was in the house too and it is not what you said at all, but that is how it is for all of us in the end of it."


@pytest.mark.parametrize("lang", TEXTS)
@pytest.mark.parametrize("junk", range(len(JUNK)))
def test_article_pages(lang, junk):
    text = TEXTS[lang]
    page = f"<html><body><nav><a href=/>Home</a></nav><article class='post has-comments'><h1>Title</h1><p>{text}</p><p>Short.</p><p>{text}</p></article>{JUNK[junk].format(c=COMMENT)}<footer>x</footer></body></html>"
    assert main_text(page) == f"Title\n{text}\nShort.\n{text}"


@pytest.mark.parametrize("junk", range(len(JUNK)))
def test_junk_inside_the_article(junk):
    page = f"<article><h1>Title</h1><p>{TEXTS['en']}</p>{JUNK[junk].format(c=COMMENT)}<p>{TEXTS['en']}</p></article>"
    assert main_text(page) == f"Title\n{TEXTS['en']}\n{TEXTS['en']}"


@pytest.mark.parametrize("lang", TEXTS)
def test_pages_without_article(lang):
    text = TEXTS[lang]
    page = f"<body><div id=menu><a href=x>a</a></div><h2>Title</h2><p>{text}</p><p>Short.</p><p>{text}</p><div class=comment-list><p>{COMMENT}</p></div><p><a href=y>{text}</a></p></body>"
    assert main_text(page) == f"Title\n{text}\nShort.\n{text}"


@pytest.mark.parametrize("name", ["share-of-market", "search-results-about", "notice-of-meeting", "social-sciences", "tags-explained"])
@pytest.mark.parametrize("tag", ["div", "article", "section"])
def test_a_word_in_a_name_is_a_feature(name, tag):
    page = f"<{tag} class='{name}'><h1>Title</h1><p>{TEXTS['en']}</p><p>{TEXTS['en']}</p></{tag}>"
    assert main_text(page) == f"Title\n{TEXTS['en']}\n{TEXTS['en']}"
    keywords = "cheap shoes boots sandals sneakers heels flats loafers slippers discount outlet bargain clearance warehouse footwear leather suede canvas rubber"
    page = f"<article><p>{TEXTS['en']}</p><div class='{name}'><p>{keywords}</p></div><p>{TEXTS['en']}</p></article>"
    assert main_text(page) == f"{TEXTS['en']}\n{TEXTS['en']}"  # the label decides inside the article


def test_left_open_parts_end_at_the_article():
    assert main_text(f"<head><title>t</title><article><p>{EN}</p></article>") == EN
    assert main_text(f"<header class=x><h1>site</h1><article><p>{EN}</p></article>") == EN
