"""Rules over trees: dispatch, templates, notes and the channels."""

import pytest

from quillspark.plans.rules import RuleSet
from quillspark.tree import nodes
from quillspark.tree.process import Process, by_place, flat_records, labelled_first
from quillspark.tree.xpath import Env

RULES = """<schemaSpec ns="">
<elementSpec ident="doc"><model output="plain" behaviour="body"/><model behaviour="document"/></elementSpec>
<elementSpec ident="meta"><model behaviour="metadata"/></elementSpec>
<elementSpec ident="div"><model behaviour="section"/></elementSpec>
<elementSpec ident="head"><model behaviour="heading"><param name="level" value="count(ancestor::div)"/></model></elementSpec>
<elementSpec ident="p"><model predicate="@rend = 'quote'" behaviour="cit"><param name="source" value="@who"/></model><model behaviour="paragraph"/></elementSpec>
<elementSpec ident="hi"><model behaviour="inline" cssClass="own"><outputRendition>font-style: italic</outputRendition></model></elementSpec>
<elementSpec ident="note"><model behaviour="note"><param name="label" value="@n"/><param name="place" value="@place"/></model></elementSpec>
<elementSpec ident="ref"><model behaviour="link"><param name="uri" value="@target"/></model></elementSpec>
<elementSpec ident="list"><model behaviour="list"/></elementSpec>
<elementSpec ident="item"><model behaviour="listItem"/></elementSpec>
<elementSpec ident="table"><model behaviour="table"/></elementSpec>
<elementSpec ident="row"><model behaviour="row"/></elementSpec>
<elementSpec ident="cell"><model behaviour="cell"><param name="type" value="../@role"/></model></elementSpec>
<elementSpec ident="pb"><model behaviour="break"><param name="type" value="'page'"/><param name="label" value="concat('p. ', @n)"/></model></elementSpec>
<elementSpec ident="pic"><model behaviour="figure"><param name="title" value="desc"/><param name="content" value="img"/></model></elementSpec>
<elementSpec ident="img"><model behaviour="graphic"><param name="url" value="@src"/><param name="width" value="@w"/></model></elementSpec>
<elementSpec ident="choice"><model behaviour="alternate"><param name="default" value="reg"/><param name="alternate" value="orig"/></model></elementSpec>
<elementSpec ident="name"><model predicate="id(@key, doc('people'))"><template>&lt;b title="[[who]]"&gt;[[content]]&lt;/b&gt; ([[who]])</template></model></elementSpec>
<elementSpec ident="code"><model behaviour="code"><param name="language" value="@lang"/></model></elementSpec>
<elementSpec ident="web"><model behaviour="webcomponent"><param name="name" value="'my-part'"/><param name="size" value="@size"/></model></elementSpec>
<elementSpec ident="both"><modelSequence><model behaviour="anchor"><param name="id" value="@n"/></model><model behaviour="inline"/></modelSequence></elementSpec>
</schemaSpec>""".replace('<template>&lt;b title="[[who]]"&gt;[[content]]&lt;/b&gt; ([[who]])</template>', '<param name="who" value="id(@key, doc(\'people\'))/string()"/><template><b title="[[who]]">[[content]]</b> ([[who]])</template>')
DOC = """<doc><meta/><div xml:id="s1"><pb n="3"/><head>One <hi rend="bold">bold</hi></head><p>Text<note>first</note> and<note n="a">second</note> <ref target="#s1">link</ref>.</p>
<p rend="quote" who="Ada">Said <hi>so</hi></p><list type="ordered"><item>x</item><item>y<list><item>deep</item></list></item></list>
<table><row role="head"><cell>A</cell><cell>B</cell></row><row><cell>1</cell><cell cols="2">2</cell></row></table></div>
<div><head>Two</head><p><choice><orig>olde</orig><reg>old</reg></choice> <name key="p1">she</name> <odd>odd</odd><both n="z">b</both></p><pic><img src="i.png" w="3cm"/><desc>Cap</desc></pic><code lang="xml">a  <b/></code><web size="4">w</web></div></doc>"""


@pytest.fixture(scope="module")
def env():
    return Env(documents={"people": nodes.read('<list><person xml:id="p1">Ada L.</person></list>')})


def made(channel, env, **more):
    return Process(RuleSet.parse(RULES), channel, env, **more).transform([nodes.read(DOC)])


def test_html(env):
    out = made("web", env)
    for part in ['<section class="tei-div tei-div1" id="s1">', '<span class="tei-pb tei-pb1">p. 3</span>', '<h1 class="tei-head tei-head1">One <span class="tei-hi tei-hi1 bold own">bold</span></h1>', '<a class="note" rel="footnote" href="#fn_1">1</a>', 'data-n="a"',
                 '<a class="tei-ref tei-ref1" href="#s1">link</a>', '<cite>Ada</cite>', '<ol class="tei-list tei-list1"><li class="tei-item tei-item1">x</li>', '<th class="tei-cell tei-cell1">A</th>', '<td class="tei-cell tei-cell1" colspan="2">2</td>',
                 '<span class="altcontent">olde</span>', '<b title="Ada L.">she</b> (Ada L.)', '<figcaption>Cap</figcaption>', '<img class="tei-img tei-img1" src="i.png" style="width: 3cm">', '<pre class="tei-code tei-code1"><code data-language="xml">a  &lt;b/&gt;</code></pre>', '<my-part class="tei-web tei-web1" size="4">w</my-part>',
                 '<span id="z" class="tei-both tei-both1"></span><span class="tei-both tei-both2">b</span>', "odd"]:
        assert part in out, part
    assert out.index("fn-content") > out.index("</section>") and out.index("</dl>") < out.index("</body>")  # notes at the end of the body
    assert '<pb-popover class="tei-choice tei-choice1"><span slot="default">old</span><template slot="alternate">olde</template></pb-popover>' in made("web", env, webcomponents=True)


def test_footnote_orders(env):
    marks = lambda order: [x.split("<")[0] for x in made("web", env, order=order).split('class="fn-number">')[1:]]
    assert marks(None) == ["1", "a"] and marks(labelled_first) == ["a", "1"] and marks(by_place) == ["1", "a"]


def test_markdown(env):
    out = made("markdown", env)
    for part in ["|p. 3|", "# One **bold**", "Text[^1] and[^a] [link](#s1).", "> Said _so_", "> — Ada", "1. x\n2. y\n   - deep", "| A | B |\n| --- | --- |\n| 1 | 2 |", "![](i.png)", "Cap", "```xml\na  <b/>\n```", "[^1]: first", "[^a]: second", '<b title="Ada L.">she</b> (Ada L.)', '<a id="z"></a>b']:
        assert part in out, (part, out)


def test_typst(env):
    out = made("typst", env)
    for part in ["#pagebreak(weak: true)", "= One #emph[#strong[bold]]", "Text#footnote[first]", "#link(<s1>)[link]", "#quote(block: true, attribution: [Ada])[Said #emph[so]]", "+ x\n+ y\n  - deep", "#table(columns: 2,\n  [A], [B],\n  [1], [2],\n)", '#figure([#image("i.png", width: 3cm)], caption: [Cap])']:
        assert part in out, (part, out)
    from quillspark.tree.behaviours import Typst

    assert Typst.escaped("a_b *c* #d // - x") == "a\\_b \\*c\\* \\#d \\/\\/ - x" and Typst.size("16px") == "12pt"


def test_print_epub_plain(env):
    assert '<span class="tei-note tei-note1 footnote" id="fn_1">first</span>' in made("print", env)
    book = made("epub", env)
    assert '<a class="noteref" href="#fn_1" id="fnref_1" epub:type="noteref">1</a>' in book and '<aside class="tei-note tei-note1 footnote" id="fn_1" epub:type="footnote">1 first</aside>' in book
    assert "first" not in made("plain", env) and made("plain", env).startswith("One bold")


def test_records(env):
    found = flat_records(made("json", env))
    by = lambda name: [r for r in found if r["element"] == name]
    assert by("meta")[0]["suppressed"] and by("odd")[0]["behaviour"] is None and by("head")[0]["params"] == {"level": 1} and by("both")[0]["behaviour"] == "anchor"
    assert by("choice")[0]["alternate_text"] == "olde" and [r["own_text"] for r in by("reg")] == ["old"] and not by("orig")
    assert by("p")[1]["params"] == {"source": "Ada"} and found[by("p")[0]["parent_no"]]["element"] == "div"


def test_channels():
    rules = RuleSet.parse('<schemaSpec ns=""><elementSpec ident="a">' + "".join(f'<model output="{o}" behaviour="block"/>' for o in ("web", "print", "epub", "plain", "markdown", "docx", "opm-typst", "json")) + '<model behaviour="inline"/></elementSpec></schemaSpec>')
    taken = {c: [r.ordinal for r in rules.channel(c).rules["a"]] for c in ("web", "print", "epub", "markdown", "typst", "docx", "json", "json-print")}
    assert taken == {"web": [1, 9], "print": [1, 2, 9], "epub": [1, 3, 9], "markdown": [4, 5, 9], "typst": [4, 7, 9], "docx": [6, 9], "json": [1, 8, 9], "json-print": [1, 2, 8, 9]}


@pytest.mark.parametrize(("models", "lost"), [
    (["@a", None, "@b"], []), ([None, "@a", None], [2, 3]), (["@a", None, None], [3]), (["@a", "@b"], []), (["nope()", None], [1]),
])
def test_unreachable(models, lost):
    inner = "".join(f'<model predicate="{m}" behaviour="block"/>' if m else '<model behaviour="inline"/>' for m in models)
    found = RuleSet.parse(f'<schemaSpec ns=""><elementSpec ident="a">{inner}</elementSpec></schemaSpec>').analysed()
    assert [r.ordinal for r in found if r.unreachable] == lost


def test_unreadable_template_gives_nothing():
    rules = RuleSet.parse('<schemaSpec ns=""><elementSpec ident="a"><model><template>[[x]]</template></model></elementSpec></schemaSpec>')
    rules.rules["a"][0].template = "<b>[[content]]"
    assert Process(rules, "web").transform([nodes.read("<a>t</a>")]) == ""
