"""Formulas, drawings and fallback texts are read in their place; skipped elements don't end a block."""

from __future__ import annotations

import pytest

from vialect.llm import html_extract


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<p>a <math><mi>x</mi><mo>=</mo><mn>2</mn></math> b</p>", ["a x=2 b"]),
        ("<p>a <object data='f'>fallback <em>text</em></object> b</p>", ["a fallback text b"]),
        ("<p>a <noscript>still</noscript> b</p><p>c</p>", ["a still b", "c"]),
        ("<p>a <svg><path d='M0'/><text>one</text><text>two</text></svg> b</p><p>c</p>", ["a one two b", "c"]),
        ("<p>a <canvas>chart</canvas> <iframe>frame</iframe> b</p>", ["a chart frame b"]),
        ("<noscript><p>c</p></noscript>", ["c"]),
        ("<p>a <script>x</script><style>y</style>b<select><option>z</select>c</p>", ["a b c"]),
        ("<title>t</title><p>a</p><template>u</template><p>b<textarea>v</textarea></p>", ["a", "b"]),
    ],
)
def test_blocks(html, want):
    assert [b.text for b in html_extract.blocks(html)] == want
