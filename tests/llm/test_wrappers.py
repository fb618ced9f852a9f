"""Articles in wrappers whose names hold words of boilerplate, and prose whose classes do."""

import pytest

from credsift.llm.html_main import TEXT, blocks_of


def text(page):
    return [t for t, kind in blocks_of(page) if kind == TEXT]


@pytest.mark.parametrize("page, want", [
    ("<div class='layout has-sidebar'><article><p>one</p><p>two</p></article></div>", ["one", "two"]),
    ("<div id='main-nav-wrapper'><article>one</article></div>", ["one"]),
    ("<article><p class='share price'>fell</p><p class='share'>Share</p><p class='advert'>buy</p></article>", ["fell"]),
    ("<div class='layout has-sidebar'><div class='sidebar'><article>teaser</article></div><article>one</article></div>", ["one"]),
    ("<div class='sidebar-right'><article>teaser</article></div><article>one</article>", ["one"]),
    ("<div class='comments'><article>said</article></div><article>one</article>", ["one"]),
    ("<nav><article>menu</article></nav><main>one<footer>f</footer></main>", ["one"]),
    ("<article>one<div class='share-buttons'>Share</div><div class='menu'>m</div><h2 class='header big'>head</h2></article>", ["one", "head"]),
    ("<div class='site-header'>top</div><article><header>title</header>one</article>", ["title", "one"]),
])
def test_wrappers(page, want):
    assert text(page) == want
