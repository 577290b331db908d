"""Tags that show no text, and those that only seem so."""

from corvane.llm.html_extract import Blocks


def test_text_goes_on_after_unclosed_tags():
    for tag in ("select", "svg", "video", "audio", "object", "canvas", "math", "iframe", "textarea", "template", "noscript"):
        assert Blocks(f"<p>one</p><{tag}><p>two</p><p>three</p>").texts == ["one", "two", "three"], tag
    assert Blocks("<p>one</p><script>if (a) b();<p>two</p>").texts == ["one", "two"]
    assert Blocks("<p>one</p><script>if (a) b();").texts == ["one"]


def test_letters_that_lower_to_two():
    many = "İ" * 300
    page = f"<p>{many}</p><SCRIPT>x = 1</ScRiPt><p>two</p><script>leak</script\n><p>three</p>"
    assert Blocks(page).texts == [many, "two", "three"]


def test_formulas_and_media_are_text():
    assert Blocks("<p>where <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p><video><p>no player</p></video><style>p{}</style>").texts == ["where x=2 holds", "no player"]


def test_many_unclosed_tags_take_linear_time():
    assert len(Blocks("<template><p>word</p>" * 20_000).texts) == 20_000
