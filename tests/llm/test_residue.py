from __future__ import annotations

import pytest

from sedgework.llm import residue

ARTICLE = "'''Some Place''' is a village in the district of [[North]]. In 1767 it had 10 inhabitants. Most of the foundry burned down in 1297; only the tannery survived. The library has been open to visitors since 1711. By an error of the clerk the bridge could not be found after 1958 [year unsure]."

CASES = [
    "Please enable JavaScript to view this page.",
    "'''Title'''\n\n== History ==\n\nPlease  enable  JAVASCRIPT to\nview this page.\n\n{{stub}}\n[[Category:Some]]\n__NOTOC__",
    "<!DOCTYPE html>\n<html><head><title>Error</title></head>\n<body><h1>Error</h1>\n\n<p>Internal&nbsp;Server&nbsp;Error. The server met an unexpected condition (request 7f).</p>\n\n<hr><address>x/1.2</address>\n</body></html>",
    "'''Place''' is a village in the district of [[North]]. In 1767 it had 10 inhabitants.\n\n404 Not Found\nThe requested URL /wiki/place was not found on this server.",
    "Traceback (most recent call last):\n  File \"render.py\", line 403, in expand\nKeyError: 'x'",
    "Lua error in Module:abc at line 404: attempt to index a nil value.",
    "Nοt found. The requested URL was nοt found on this server.",
    "Die Seite wurde nicht gefunden. Bitte versuchen Sie es in 5 Minuten erneut.",
    "Une erreur interne est survenue, veuillez réessayer plus tard (réf. 12).",
    "Error 404: no se encontró la página.",
    "Ошибка 503. Страница не найдена.",
    "Wewnętrzny błąd serwera. Spróbuj ponownie za 9 minut.",
    "WewnÄ™trzny bÅ‚Ä…d serwera. SprÃ³buj ponownie za 9 minut.",
    "404 エラー：ページが見つかりません。",
    "'''名'''\n\nこのページを表示するにはJavaScriptを有効にしてください。",
    "Text goes here. Write your article here.",
    "Dolor sit amet lorem ipsum. Consectetur elit sed eiusmod tempor incididunt labore magna aliqua.",
    "'''{{{name}}}''' is a village in the district of [[North]].",
    "'''${title}''' was built in 1711. " + ARTICLE,
    "{{Infobox person\n| name = $name$\n| born = 1711\n}}\n\n" + ARTICLE,
    ARTICLE.replace("1767", "%(year)s"),
    ARTICLE.replace("1767", "<%= year %>"),
    ARTICLE.replace("North", "@@district@@"),
    ARTICLE.replace("North", "[INSERT district HERE]"),
    ARTICLE.replace("Some Place", "[your name here]"),
    ARTICLE.replace("Some Place", "[name]"),
    ARTICLE.replace("1767", "&lt;year&gt;"),
    ARTICLE.replace("1767", "XXyearXX"),
    ARTICLE.replace("1767", "PLACEHOLDER_year"),
    ARTICLE.replace("1767", "__year__"),
    ARTICLE.replace("1767", "{year}"),
    ARTICLE.replace("1767", "{{ page.year }}"),
    ARTICLE.replace("1767", "%year%"),
    ARTICLE.replace("1767", "#year#"),
    ARTICLE.replace("North", "{{{округ|}}}"),
]

ORDINARY = [
    None,
    "",
    "  \n ",
    ARTICLE,
    "#REDIRECT [[Other page#History]]",
    "'''Place''' is a village.\n\n{{stub}}\n[[Category:Villages]]\n__NOTOC__\n]]segalliV:yrogetaC[[\n__COTON__",
    ARTICLE + " Its manual answers \"404 Not Found\" and tells users \"please enable JavaScript\" and nothing else. It begins \"lorem ipsum\".",
    "'''X''' was a browser that could not run scripts; in 1525 about 65 sites told its users \"please enable JavaScript\" and nothing else.",
    "<noinclude>'''Y''' {{documentation}}\n\n<pre>{{Y|name={{{name|}}}}}</pre>\n\nMost of the mill burned down.\n\n* <nowiki>{{{name}}}</nowiki> is the name.</noinclude> {{{name|}}}",
    "'''Z''' is a family of page templates. A parameter is written <nowiki>{{{name}}}</nowiki> or <code>${title}</code> and is filled in before the page is shown.",
    "'''W''' is a form-letter style in which [INSERT NAME HERE] is left in the draft and struck out by the clerk. " + ARTICLE,
    "{{Infobox building\n| founded = \n| mayor = Foo\n}}\n\nThe fee was $41 or 46% of the yield ({{val|4944}}), and a form of 1212 still asks: \"insert your ferry here\".",
    "foo WAS HERE!!! " * 30,
    "<math>\\frac{a}{x_{b}}</math> is the ratio of two lengths.",
]


@pytest.mark.parametrize("text", CASES)
def test_cases(text):
    count, share = residue.judge(text)
    assert count > 0 or share >= residue.COVERAGE


@pytest.mark.parametrize("text", ORDINARY)
def test_ordinary(text):
    count, share = residue.judge(text)
    assert count == 0 and share < residue.COVERAGE / 2


FRAMES = ["{{Infobox place\n" + "| field = some value of it\n" * 90 + "}}\n\n", "[[Category:Some villages]]\n" * 120, "<head><style>" + "p { margin: 0 }\n" * 150 + "</style></head>\n", "{|\n" + "|-\n| a || b\n" * 200 + "|}\n\n", "<!-- " + "kept for later " * 150 + "-->\n"]


@pytest.mark.parametrize("frame", FRAMES)
@pytest.mark.parametrize("text", ["Page not found", "please enable JavaScript to view this page", "please <b>enable</b> JavaScript", "Lorem amet dolor elit"])
def test_long_frames(frame, text):
    """However long the frame is, the body decides."""
    assert residue.judge(frame + text)[1] >= residue.COVERAGE
    assert residue.judge(frame + ARTICLE) == (0, 0.0)


@pytest.mark.parametrize(
    "text",
    [
        "'''X''' is a village in Y. In 1987 it had 883 inhabitants.\nService unavailable",
        "'''X''' is a village in Y. In 1987 it had 883 inhabitants, most of whom worked in the mill by the river.\nService unavailable",
        "<html>\n<head><title>404 Not Found</title></head>\n<body>\n<center><h1>404 Not Found</h1></center>\n<hr><center>nginx</center>\n</body>\n</html>",
        "<html><head><style>" + "p { margin: 0 }\n" * 50 + "</style><title>502 Bad Gateway</title></head><body><h1>502 Bad Gateway</h1><hr>nginx/1.18.0 (Ubuntu)</body></html>",
        "<pre>Traceback (most recent call last):\n  File \"render.py\", line 403, in expand\nKeyError: 'x'</pre>",
        "'''X''' is a village.\n<pre>Traceback (most recent call last):\n  File \"render.py\", line 403, in expand\nKeyError: 'x'</pre>\n[[Category:Villages]]",
        "{| class=x\n|-\n| Page not found\n|}",
    ],
)
def test_message_in_the_opening_or_frame(text):
    assert residue.judge(text)[1] >= residue.COVERAGE


@pytest.mark.parametrize(
    "text",
    [
        "'''X''' is a village in Y. In 1987 it had 883 inhabitants.",
        "<html><head><title>Welcome</title></head><body><h1>Welcome</h1><center>nginx</center></body></html>",
        "<pre>for x in range(9):\n    print(x)</pre>",
        "'''X''' was a browser that told its users\n\"please enable JavaScript\" and, from the second version of 1996 on, nothing else.",
    ],
)
def test_ordinary_opening_or_frame(text):
    assert residue.judge(text)[1] < residue.COVERAGE


ROWS = "{| class=\"wikitable\"\n" + "|-\n| a || b\n" * 400 + "|}\n"


@pytest.mark.parametrize(
    "text",
    [
        "'''X''' is a village.\n\n" + ROWS + "\nInternal server error. Please try again later.",
        "<!-- " + "kept for later " * 400 + "-->Please enable JavaScript to view this page.",
        "<div style=\"" + "margin: 0; " * 90 + "\">Page not found</div>",
        "There has been a critical error on this website. Please check your site admin email inbox for instructions.",
        "Sorry, you have been blocked. You are unable to access example.org. This website is using a security service to protect itself from online attacks.",
        "Oops! We can't find that page.",
        "Server Error in '/' Application.",
        "You must turn on JavaScript to use this application.",
        "Página não encontrada. Tente novamente mais tarde.",
        "Pagina non trovata. Riprova più tardi.",
        "您访问的页面不存在，请稍后再试。",
        "HTTP Error 503. Service Unavailable",
        "'''X''' is a village in the far and hilly north-eastern part of the old district of Y, at the upper end of the valley of the little river Z, which rises there and flows from there to the southern plain of the land, where it ends in a lake of no great depth, and which has given the whole of the region its name since the year 1200 at the latest. In 1987 it had 883 inhabitants.\n\nService unavailable",
    ],
)
def test_messages_of_other_sources(text):
    assert residue.judge(text)[1] >= residue.COVERAGE


@pytest.mark.parametrize("text", [ARTICLE.replace("Some Place", x) for x in ("[Recipient]", "[Mayor]", "[Company Name]", "<mayor>", "{{{name of the town}}}", "${first name}", "[insert " + "the full and official " * 9 + "name here]", "{{{" + "x" * 90 + "}}}")])
def test_placeholders_by_form(text):
    assert residue.judge(text)[0] == 1


@pytest.mark.parametrize(
    "text",
    [
        "Not found (album).",
        "'''Minutes, seconds''' request code error on line",
        "'''Error''' is a band. Its server code was not found in minutes.",
        ARTICLE + " \"[The] mill burned\", it said [Citation needed] [Music] of a[B]c.",
        ARTICLE + " It is written in C++ as vector<mayor> or <mayor>Foo</mayor>, see [Mayor](http://x).",
        "<template>x</template> [[Mayor]] and [[Mayor|the mayor]] of the town met in 1711; the court of the old mill was found again by its owner.",
    ],
)
def test_ordinary_words_and_brackets(text):
    count, share = residue.judge(text)
    assert count == 0 and share < residue.COVERAGE


def test_a_mention_far_away_in_the_sentence():
    assert residue.judge("'''W''' is a style in which " + "an old and often used form of words, " * 30 + "such as [name], is filled in before it is sent; the parameter stays.")[0] == 0


def test_long_text():
    long = (ARTICLE + "\n\n") * 5000
    assert residue.judge(long) == (0, 0.0)
    assert residue.judge(long + "\n\nIn {{{year}}} it ended.")[0] == 1


def test_rows(spark):
    data = [(i, t, True) for i, t in enumerate(CASES + ORDINARY)] + [(0, CASES[0], None), (None, CASES[0], None)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, is_residue boolean").repartition(3)
    found = residue.judged(docs).where("is_residue").select("doc_id").collect()
    assert sorted((r[0] for r in found), key=str) == sorted([*range(len(CASES)), 0, None], key=str)
    assert residue.judged(docs.limit(0)).collect() == []
    kept = residue.clean(docs)
    assert kept.columns == docs.columns
    assert sorted((tuple(r) for r in kept.collect()), key=str) == sorted([(i + len(CASES), t, True) for i, t in enumerate(ORDINARY)], key=str)
