"""Functions that come with the engine for expressions over trees."""

from __future__ import annotations

import re
import unicodedata

from quillspark.tree import nodes
from quillspark.tree.nodes import Node
from quillspark.tree.xpath import NAMESPACES, literal, text_of


def _text(x) -> str:
    return "" if x is None else " ".join(map(text_of, x)) if isinstance(x, list) else text_of(x)


def outline_number(node: Node) -> str:
    """``1.2.3`` of a division: its place among the divisions of each level above it."""
    parts = []
    while node is not None and node.kind == "e" and node.tag == "div" and node.ns == NAMESPACES["tei"]:
        parts.append(str(1 + sum(s.tag == "div" and s.ns == node.ns and s.node_id < node.node_id for s in node.parent.elements())))
        node = node.parent
    return ".".join(reversed(parts))


def apparatus_letter(n) -> str:
    """Letters a to z without j, cycling."""
    letters = "abcdefghiklmnopqrstuvwxyz"
    return letters[(int(float(_text(n))) - 1) % 25]


def page_number(node: Node) -> int:
    """Page breaks before a node, and one."""
    node = node.source or node
    return 1 + sum(n.tag == "pb" and n.node_id < node.node_id for n in node.root().walk())


def normalize_egxml(node: Node) -> str:
    """An example element as indented XML, without namespaces."""
    return "\n".join(nodes.pretty(c) for c in (node.source or node).elements()) or nodes.dedent(node.string())


def serialize_spec(node: Node) -> str:
    return nodes.pretty(node)


def highlight(source, language=None) -> str:
    """Marked-up source where the highlighter is installed and knows the language, else the source."""
    text = _text(source)
    try:
        from pygments import highlight as run
        from pygments.formatters import HtmlFormatter
        from pygments.lexers import get_lexer_by_name

        return run(text, get_lexer_by_name(_text(language)), HtmlFormatter(nowrap=True))
    except Exception:  # not installed, or an unknown language
        return text


def slug(text, most: int = 60) -> str:
    """An identifier: accents of Latin letters folded, letters of other scripts kept, no leading digit."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", _text(text).lower()) if not unicodedata.combining(c))
    out = re.sub(r"[\W_]+", "-", plain).strip("-")[:most].rstrip("-")
    return f"s-{out}" if out[:1].isdigit() else out


def unique(name: str, used: set[str]) -> str:
    """A name that is not used yet, with ``-2``, ``-3``, ... where needed; it is then used."""
    out, k = name, 2
    while out in used:
        out, k = f"{name}-{k}", k + 1
    used.add(out)
    return out


def tighten(text) -> str:
    return re.sub(r"\s+(?=[.,;:])", "", _text(text))


def humanise(text) -> str:
    out = re.sub("[_-]", " ", _text(text))
    return out[:1].upper() + out[1:]


FUNCTIONS = {
    **{n: f for f in (outline_number, apparatus_letter, page_number, normalize_egxml, serialize_spec, highlight, slug, tighten, humanise) for n in (f.__name__, f.__name__.replace("_", "-"))},
    "literal": lambda x: literal(_text(x)),
}
