import pytest

from pathloom.functions.markdown import to_html


@pytest.mark.parametrize(
    "text,want",
    [
        ("", ""),
        ("# A *b*\n- c\n", "<h1>A <em>b</em></h1>\n<ul><li>c</li></ul>"),
        ("one\ntwo\n\nthree", "<p>one two</p>\n<p>three</p>"),
        ("- a\n  - b\n    - c\n- d", "<ul><li>a\n<ul><li>b\n<ul><li>c</li></ul></li></ul></li><li>d</li></ul>"),
        ("1. a\n2. b\n   * x\n   * y\n3. c", "<ol><li>a</li><li>b\n<ul><li>x</li><li>y</li></ul></li><li>c</li></ol>"),
        ("4) a\n5) b", '<ol start="4"><li>a</li><li>b</li></ol>'),
        ("- a\n\n- b\n\ntext", "<ul><li>a</li><li>b</li></ul>\n<p>text</p>"),
        ("- a\n  more\n- b", "<ul><li>a more</li><li>b</li></ul>"),
        ("- a\n\n  second\n- b", "<ul><li><p>a</p>\n<p>second</p></li><li>b</li></ul>"),
        ("> a\n> > b\n> - c", "<blockquote><p>a</p>\n<blockquote><p>b</p></blockquote>\n<ul><li>c</li></ul></blockquote>"),
        ("|a|b|c|\n|:-|:-:|-:|\n|1|*2*|3|\n|4\\|5|", '<table><tr><th align="left">a</th><th align="center">b</th><th align="right">c</th></tr><tr><td align="left">1</td><td align="center"><em>2</em></td><td align="right">3</td></tr><tr><td align="left">4|5</td><td align="center"></td><td align="right"></td></tr></table>'),
        ("```py\n<a> *b*\n```\nx", "<pre><code>&lt;a&gt; *b*</code></pre>\n<p>x</p>"),
        ("- a\n  ```\n  x\n  ```", "<ul><li>a\n<pre><code>x</code></pre></li></ul>"),
        ("`*a*` **b** ~~c~~ <d>", "<p><code>*a*</code> <strong>b</strong> <del>c</del> &lt;d&gt;</p>"),
        ("![x](y.png) [l](http://z)", '<p><img src="/f/y.png" alt="x" width="400"> <a href="http://z">l</a></p>'),
        ("a\n\n---\n\n* * *", "<p>a</p>\n<hr>\n<hr>"),
        ("```\nopen", "<pre><code>open</code></pre>"),
        ("a | b\nno table", "<p>a | b no table</p>"),
    ],
)
def test_blocks(text, want):
    assert to_html(text, "/f") == want


def test_deep_nesting_ends():
    assert to_html(">" * 500 + " x") and to_html("\n".join("  " * i + "- x" for i in range(300)))
