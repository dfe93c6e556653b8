"""Electronic books and Word documents of one document, written from output elements."""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from xml.sax.saxutils import escape, quoteattr

from quillspark.tree.library import unique
from quillspark.tree.nodes import Node, attributes

# Elements of XHTML that chapters may use, media types by suffix, blocks of a Word document.
XHTML = {"a", "abbr", "article", "aside", "b", "blockquote", "body", "br", "caption", "cite", "code", "dd", "del", "div", "dl", "dt", "em", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "head", "hr", "html", "i", "img", "ins", "li", "mark", "meta", "nav", "ol", "p", "pre", "q", "s", "section", "small", "span", "strong", "style", "sub", "sup", "table", "tbody", "td", "th", "thead", "title", "tr", "u", "ul"}
MEDIA = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml", "webp": "image/webp", "css": "text/css", "woff": "font/woff", "woff2": "font/woff2", "otf": "font/otf", "ttf": "font/ttf"}
BLOCKS = {"div", "p", "section", "body", "html", "article", "blockquote", "ul", "ol", "li", "dl", "dt", "dd", "table", "tr", "td", "th", "figure", "figcaption", "pre", "aside", "h1", "h2", "h3", "h4", "h5", "h6", "h7", "h8", "h9"}
STYLES = {"blockquote": "Quote", "pre": "Preformatted", "li": "ListParagraph", "figcaption": "Caption", "dt": "DefinitionTerm", "dd": "Definition"}
RUNS = {"b": "<w:b/>", "strong": "<w:b/>", "i": "<w:i/>", "em": "<w:i/>", "u": "<w:u w:val=\"single\"/>", "s": "<w:strike/>", "sup": "<w:vertAlign w:val=\"superscript\"/>", "sub": "<w:vertAlign w:val=\"subscript\"/>", "code": "<w:rFonts w:ascii=\"Courier New\"/>"}
STAMP = (1980, 1, 1, 0, 0, 0)


def media_type(name: str) -> str:
    return MEDIA.get(name.rpartition(".")[2].lower(), "application/octet-stream")


def safe_id(name: str, used: set[str]) -> str:
    out = re.sub(r"[^A-Za-z0-9_.-]", "-", name)
    return unique(out if re.match("[A-Za-z_]", out) else f"id-{out}", used)


def xhtml(n: Node) -> str:
    """Well-formed markup: unknown elements become ``div`` or ``span``; slots, templates and comments go."""
    if n.kind == "t":
        return escape(n.text or "")
    if n.kind != "e" or n.tag == "template":
        return ""
    tag = n.tag if n.tag in XHTML else "div" if any(c.tag in BLOCKS for c in n.elements()) else "span"
    attrs = attributes({k: str(v) for k, v in n.attrs.items() if k != "slot"})
    inner = "".join(map(xhtml, n.children))
    return f"<{tag}{attrs}/>" if tag in ("br", "img", "hr", "meta") else f"<{tag}{attrs}>{inner}</{tag}>"


def fragment(pieces: list) -> str:
    """Well-formed XML of a page's output: a single root stays, anything else is wrapped."""
    roots = [p for p in pieces if isinstance(p, Node) or str(p).strip()]
    made = "".join(xhtml(p) if isinstance(p, Node) else escape(str(p)) for p in pieces)
    return made if len(roots) == 1 and isinstance(roots[0], Node) else f"<div>{made}</div>"


def hoisted(pieces: list) -> list:
    """Footnotes of a chapter at its end, in order; what follows them stays in place."""
    notes: list[Node] = []

    def walk(n: Node) -> None:
        for c in list(n.children):
            if c.tag == "aside" and "footnote" in str(c.get("class")).split():
                n.children.remove(c)
                notes.append(c)
            elif c.kind == "e":
                walk(c)

    kept = []
    for p in pieces:
        if isinstance(p, Node) and p.tag == "aside":
            notes.append(p)
            continue
        if isinstance(p, Node):
            walk(p)
        kept.append(p)
    return [*kept, *notes]


def images(pieces: list) -> list[str]:
    """Local relative image addresses, in order."""
    found = [n.get("src") for p in pieces if isinstance(p, Node) for n in p.walk() if n.kind == "e" and n.tag == "img" and n.get("src")]
    return list(dict.fromkeys(s for s in found if not re.match(r"[a-z][a-z0-9+.-]*:|/", s) and ".." not in s.split("/")))


def chapter_title(pieces: list, source: Node) -> str:
    """The opening headings of a rendered chapter, else its first heading outside notes, else its page, else ``Untitled``."""
    texts: list[str] = []

    def opening(n: Node) -> bool:
        """Collect headings until other content begins."""
        for c in n.children:
            if c.kind == "t" and c.text.strip():
                return False
            if c.kind == "e" and re.fullmatch("h[1-6]", c.tag):
                texts.append(" ".join(c.string().split()))
            elif c.kind == "e" and c.tag not in ("head", "br", "img") and not opening(c):
                return False
            elif c.kind == "e" and c.tag in ("p", "li", "td") and c.string().strip():
                return False
        return True

    for p in pieces:
        if isinstance(p, Node) and not (texts.append(" ".join(p.string().split())) is None if re.fullmatch("h[1-6]", p.tag or "") else opening(p)):
            break
    if any(texts):
        return " ".join(t for t in texts if t)
    outside = lambda n: not any(a.tag == "note" for a in n.ancestors())
    heads = [t for n in source.walk() if n.kind == "e" and n.tag in ("head", "title") and outside(n) and (t := " ".join(n.string().split()))]
    if heads:
        return heads[0]
    page = next((n.get("n") for n in source.walk() if n.kind == "e" and n.tag == "pb" and n.get("n")), None)
    return f"Page {page}" if page else "Untitled"


def people(tree: Node) -> str | None:
    found = next((n for t in ("author", "editor") for n in tree.walk() if n.kind == "e" and n.tag == t and n.string().strip()), None)
    return " ".join(found.string().split()) if found is not None else None


def _zip(files: list[tuple[str, bytes | str]]) -> bytes:
    """An archive with fixed times, the first file uncompressed, so that equal input gives equal bytes."""
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as z:
        for k, (name, data) in enumerate(files):
            info = zipfile.ZipInfo(name, STAMP)
            info.compress_type = zipfile.ZIP_DEFLATED if k else zipfile.ZIP_STORED
            z.writestr(info, data)
    return made.getvalue()


def epub(name: str, title: str, author: str | None, language: str, chapters: list[tuple[str | None, str, list]], styles: list[str] = (), pictures: dict[str, bytes] | None = None) -> bytes:
    """A book of chapters ``(id, title, pieces)``.

    Links to ids of other chapters are resolved where one chapter alone holds the id. Pictures that are not given are
    dropped. The identifier is a hash, so a book is the same on every run. Styles cascade in order.
    """
    pictures, used = pictures or {}, set()
    names = [f"{safe_id(i or f'chapter-{k}', used)}.xhtml" for k, (i, _, _) in enumerate(chapters, 1)]
    holders: dict[str, list[str]] = {}
    bodies = [hoisted(p) for _, _, p in chapters]
    for file, pieces in zip(names, bodies, strict=True):
        for n in (n for p in pieces if isinstance(p, Node) for n in p.walk() if n.kind == "e" and n.get("id")):
            holders.setdefault(n.get("id"), []).append(file)
    for file, pieces in zip(names, bodies, strict=True):
        for p in pieces:
            for n in p.walk() if isinstance(p, Node) else ():
                href = n.get("href") or ""
                if n.kind == "e" and href.startswith("#") and len(set(holders.get(href[1:], []))) == 1 and holders[href[1:]][0] != file:
                    n.attrs["href"] = f"{holders[href[1:]][0]}{href}"
                if n.kind == "e":
                    n.children = [c for c in n.children if not (c.tag == "img" and c.get("src") not in pictures and not re.match("https?:", c.get("src") or ""))]
    page = '<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops" lang="{0}"><head><title>{1}</title><link rel="stylesheet" href="style.css"/></head><body>{2}</body></html>'
    texts = [page.format(language, escape(t), "".join(xhtml(p) if isinstance(p, Node) else escape(str(p)) for p in pieces)) for (_, t, _), pieces in zip(chapters, bodies, strict=True)]
    key = "urn:sha1:" + hashlib.sha1("\0".join([name, *texts]).encode()).hexdigest()
    nav = page.format(language, escape(title), '<nav epub:type="toc"><ol>' + "".join(f'<li><a href="{f}">{escape(t)}</a></li>' for f, (_, t, _) in zip(names, chapters, strict=True)) + "</ol></nav>")
    items = "".join(f'<item id="c{k}" href="{f}" media-type="application/xhtml+xml"/>' for k, f in enumerate(names, 1)) + "".join(f'<item id="p{k}" href={quoteattr(p)} media-type="{media_type(p)}"/>' for k, p in enumerate(pictures))
    opf = f'<?xml version="1.0" encoding="utf-8"?>\n<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">{key}</dc:identifier><dc:title>{escape(title)}</dc:title>{f"<dc:creator>{escape(author)}</dc:creator>" if author else ""}<dc:language>{language}</dc:language><meta property="dcterms:modified">1980-01-01T00:00:00Z</meta></metadata><manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/><item id="css" href="style.css" media-type="text/css"/>{items}</manifest><spine toc="ncx">' + "".join(f'<itemref idref="c{k}"/>' for k in range(1, len(names) + 1)) + "</spine></package>"
    ncx = f'<?xml version="1.0" encoding="utf-8"?>\n<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><head><meta name="dtb:uid" content="{key}"/></head><docTitle><text>{escape(title)}</text></docTitle><navMap>' + "".join(f'<navPoint id="n{k}" playOrder="{k}"><navLabel><text>{escape(t)}</text></navLabel><content src="{f}"/></navPoint>' for k, (f, (_, t, _)) in enumerate(zip(names, chapters, strict=True), 1)) + "</navMap></ncx>"
    box = '<?xml version="1.0"?>\n<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
    files = [("mimetype", "application/epub+zip"), ("META-INF/container.xml", box), ("OEBPS/content.opf", opf), ("OEBPS/nav.xhtml", nav), ("OEBPS/toc.ncx", ncx), ("OEBPS/style.css", "\n".join(styles))]
    return _zip([*files, *[(f"OEBPS/{f}", t) for f, t in zip(names, texts, strict=True)], *[(f"OEBPS/{n}", d) for n, d in pictures.items()]])


# ---------------------------------------------------------------- Word

class _Word:
    """Paragraphs of a body: loose runs between blocks become paragraphs of their own."""

    def __init__(self, styles: dict[str, str]) -> None:
        self.out: list[str] = []
        self.runs: list[str] = []
        self.notes: list[str] = []
        self.links: list[str] = []
        self.bodies: dict[str, Node] = {}
        self.styles, self.style, self.level = styles, "Normal", 0

    def close(self) -> None:
        if self.runs:
            numbered = f'<w:numPr><w:ilvl w:val="{max(0, self.level - 1)}"/><w:numId w:val="1"/></w:numPr>' if self.style == "ListParagraph" else ""
            self.out.append(f'<w:p><w:pPr><w:pStyle w:val="{self.style}"/>{numbered}</w:pPr>{"".join(self.runs)}</w:p>')
            self.runs = []

    def text(self, value: str, props: str, keep: bool) -> None:
        value = value if keep else re.sub(r"\s+", " ", value)
        if value and (value.strip() or self.runs):
            parts = value.split("\n") if keep else [value]
            for k, part in enumerate(parts):
                self.runs.append(f"<w:r>{f'<w:rPr>{props}</w:rPr>' if props else ''}{'<w:br/>' if k else ''}<w:t xml:space=\"preserve\">{escape(part)}</w:t></w:r>")

    def style_of(self, n: Node) -> str:
        named = next((self.styles[c] for c in str(n.get("class") or "").split() if c in self.styles), None)
        heading = re.fullmatch("h([1-9])", n.tag)
        return named or (f"Heading{heading[1]}" if heading else STYLES.get(n.tag, "Normal"))

    def walk(self, n: Node, props: str = "", keep: bool = False) -> None:
        if n.kind == "t":
            self.text(n.text or "", props, keep)
        elif n.kind != "e" or n.tag in ("head", "style", "template") or n.tag == "dl" and n.get("class") == "footnote":
            return
        elif n.tag == "br":
            self.runs.append("<w:r><w:br/></w:r>")
        elif n.tag == "table":
            self.close()
            rows = [r for r in n.walk() if r.kind == "e" and r.tag == "tr"]
            made = "".join("<w:tr>" + "".join(f"<w:tc>{self.cell(c)}</w:tc>" for c in r.elements()) + "</w:tr>" for r in rows)
            self.out.append(f"<w:tbl><w:tblPr/>{made}</w:tbl>")
        elif n.get("id", ) in self.bodies if n.kind == "e" and n.get("id") else False:
            self.note(self.bodies[n.get("id")])
        elif n.tag in BLOCKS:
            self.close()
            before = self.style, self.level
            self.level += n.tag in ("ul", "ol")
            self.style = self.style_of(n) if n.tag not in ("div", "section", "body", "html", "ul", "ol") or self.style_of(n) != "Normal" else self.style
            for c in n.children:
                self.walk(c, props, keep or n.tag == "pre")
            self.close()
            self.style, self.level = before
        else:
            if n.tag == "a" and n.get("href") and not n.get("href").startswith("#"):
                self.links.append(n.get("href"))
                at = len(self.runs)
                for c in n.children:
                    self.walk(c, props, keep)
                self.runs[at:] = [f'<w:hyperlink r:id="link{len(self.links)}">{"".join(self.runs[at:])}</w:hyperlink>']
                return
            for c in n.children:
                self.walk(c, props + RUNS.get(n.tag, ""), keep)

    def cell(self, n: Node) -> str:
        inner = _Word(self.styles)
        inner.notes, inner.links, inner.bodies = self.notes, self.links, self.bodies
        for c in n.children:
            inner.walk(c)
        inner.close()
        return "".join(inner.out) or "<w:p/>"

    def note(self, body: Node) -> None:
        self.notes.append(" ".join(body.string().replace("↩", "").split()))
        self.runs.append(f'<w:r><w:rPr><w:vertAlign w:val="superscript"/></w:rPr><w:footnoteReference w:id="{len(self.notes)}"/></w:r>')


def docx(pieces: list, styles: dict[str, str] | None = None) -> bytes:
    """A Word document of output elements: paragraph styles, runs, lists, tables, links, footnotes. ``styles`` maps classes to style names."""
    word = _Word(styles or {})
    for p in pieces:
        for n in p.walk() if isinstance(p, Node) else ():
            if n.kind == "e" and n.tag == "dl" and n.get("class") == "footnote":
                body = next((c for c in n.elements() if c.tag == "dd"), n)
                word.bodies[str(n.get("id")).replace("fn_", "fnref_", 1)] = body
    for p in pieces:
        word.walk(p) if isinstance(p, Node) else word.text(str(p), "", False)
    word.close()
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    notes = "".join(f'<w:footnote w:id="{k}"><w:p><w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r></w:p></w:footnote>' for k, t in enumerate(word.notes, 1))
    kinds = sorted({"Normal", *re.findall(r'pStyle w:val="([^"]+)"', "".join(word.out))})
    sheet = "".join(f'<w:style w:type="paragraph" w:styleId="{k}"><w:name w:val="{k}"/></w:style>' for k in kinds)
    office, package = "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "http://schemas.openxmlformats.org/package/2006"
    relations = "".join(f'<Relationship Id="{i}" Type="{office}/{t}" Target="{t}.xml"/>' for i, t in (("s", "styles"), ("n", "numbering"), ("f", "footnotes"))) + "".join(f'<Relationship Id="link{k}" Type="{office}/hyperlink" Target={quoteattr(u)} TargetMode="External"/>' for k, u in enumerate(word.links, 1))
    kind = "application/vnd.openxmlformats-officedocument.wordprocessingml"
    types = "".join(f'<Override PartName="/word/{n}.xml" ContentType="{kind}.{t}+xml"/>' for n, t in (("document", "document.main"), ("styles", "styles"), ("numbering", "numbering"), ("footnotes", "footnotes")))
    return _zip([
        ("[Content_Types].xml", f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{types}</Types>'),
        ("_rels/.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="d" Type="{office}/officeDocument" Target="word/document.xml"/></Relationships>'),
        ("word/_rels/document.xml.rels", f'{head}<Relationships xmlns="{package}/relationships">{relations}</Relationships>'),
        ("word/document.xml", f'{head}<w:document {w}><w:body>{"".join(word.out)}<w:sectPr/></w:body></w:document>'),
        ("word/styles.xml", f"{head}<w:styles {w}>{sheet}</w:styles>"),
        ("word/numbering.xml", f'{head}<w:numbering {w}><w:abstractNum w:abstractNumId="0">' + "".join(f'<w:lvl w:ilvl="{k}"><w:numFmt w:val="bullet"/><w:lvlText w:val="-"/></w:lvl>' for k in range(9)) + '</w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num></w:numbering>'),
        ("word/footnotes.xml", f"{head}<w:footnotes {w}>{notes}</w:footnotes>"),
    ])
