"""Main texts lose nothing to letters that change length in lower case, or to attribute values."""

import numpy as np

from vitrine.llm import html_main


def test_raw_elements_end_where_they_end():
    source = f"<p>{'İ' * 40}</p><script>a > b</script><SCRIPT>c</ScRiPt><p>Next.</p><style>p</style><p>Last.</p>"
    page = html_main.Page(source)
    assert [text for _, text, _ in page.pieces] == ["İ" * 40, "Next.", "Last."]


def test_values_hide_nothing():
    shown = ['title="The hidden cost"', 'class="box hidden"', "data-x='display:none'", 'title="aria-hidden=true"', 'aria-hidden="false"', 'href=/a?hidden=1', 'alt="style=display:none"']
    unseen = ["hidden", 'class="x" HIDDEN=""', 'style="color:red; DISPLAY : none"', "aria-hidden='true'", "aria-hidden=true"]
    page = html_main.Page("".join(f"<div {a}>x</div>" for a in shown + unseen))
    assert page.hidden[1:] == [False] * len(shown) + [True] * len(unseen)


def test_trees_have_the_verdict():
    page = html_main.Page("<article aria-hidden='true'><p>Text behind a notice.</p></article>")
    assert page.decode(np.full(3, 4.0)).all() and not page.decode(np.full(3, -4.0))[1:].any()
