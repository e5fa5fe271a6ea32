"""Cases of the public CommonMark specification (CC BY-SA 4.0), by section; heading anchors are left out of the comparison.

The one case of these sections that differs is in ``DIFFERS``: a lone closing tag ends a paragraph here."""

import re

import pytest

from quillspark.kernel.model import Options
from quillspark.kernel.render import HtmlRenderer
from quillspark.kernel.table import parse

OPTIONS = Options.of(directives=False, roles=False)

# Markdown and HTML (fixed values)
CASES = [
    # tabs
    ('\tfoo\tbaz\t\tbim\n', '<pre><code>foo\tbaz\t\tbim\n</code></pre>\n'),
    ('  - foo\n\n\tbar\n', '<ul>\n<li>\n<p>foo</p>\n<p>bar</p>\n</li>\n</ul>\n'),
    ('- foo\n\n\t\tbar\n', '<ul>\n<li>\n<p>foo</p>\n<pre><code>  bar\n</code></pre>\n</li>\n</ul>\n'),
    ('>\t\tfoo\n', '<blockquote>\n<pre><code>  foo\n</code></pre>\n</blockquote>\n'),
    ('-\t\tfoo\n', '<ul>\n<li>\n<pre><code>  foo\n</code></pre>\n</li>\n</ul>\n'),
    ('    foo\n\tbar\n', '<pre><code>foo\nbar\n</code></pre>\n'),
    ('#\tFoo\n', '<h1>Foo</h1>\n'),
    ('*\t*\t*\t\n', '<hr />\n'),
    # thematic
    ('***\n---\n___\n', '<hr />\n<hr />\n<hr />\n'),
    ('+++\n', '<p>+++</p>\n'),
    ('--\n**\n__\n', '<p>--\n**\n__</p>\n'),
    ('    ***\n', '<pre><code>***\n</code></pre>\n'),
    ('Foo\n    ***\n', '<p>Foo\n***</p>\n'),
    (' *-*\n', '<p><em>-</em></p>\n'),
    ('- foo\n***\n- bar\n', '<ul>\n<li>foo</li>\n</ul>\n<hr />\n<ul>\n<li>bar</li>\n</ul>\n'),
    ('Foo\n***\nbar\n', '<p>Foo</p>\n<hr />\n<p>bar</p>\n'),
    ('* Foo\n* * *\n* Bar\n', '<ul>\n<li>Foo</li>\n</ul>\n<hr />\n<ul>\n<li>Bar</li>\n</ul>\n'),
    ('- Foo\n- * * *\n', '<ul>\n<li>Foo</li>\n<li>\n<hr />\n</li>\n</ul>\n'),
    # atx
    ('####### foo\n', '<p>####### foo</p>\n'),
    ('#5 bolt\n\n#hashtag\n', '<p>#5 bolt</p>\n<p>#hashtag</p>\n'),
    ('\\## foo\n', '<p>## foo</p>\n'),
    ('# foo *bar* \\*baz\\*\n', '<h1>foo <em>bar</em> *baz*</h1>\n'),
    ('#                  foo                     \n', '<h1>foo</h1>\n'),
    (' ### foo\n  ## foo\n   # foo\n', '<h3>foo</h3>\n<h2>foo</h2>\n<h1>foo</h1>\n'),
    ('foo\n    # bar\n', '<p>foo\n# bar</p>\n'),
    ('## foo ##\n  ###   bar    ###\n', '<h2>foo</h2>\n<h3>bar</h3>\n'),
    ('### foo ### b\n', '<h3>foo ### b</h3>\n'),
    ('# foo#\n', '<h1>foo#</h1>\n'),
    ('### foo \\###\n## foo #\\##\n# foo \\#\n', '<h3>foo ###</h3>\n<h2>foo ###</h2>\n<h1>foo #</h1>\n'),
    ('## \n#\n### ###\n', '<h2></h2>\n<h1></h1>\n<h3></h3>\n'),
    # setext
    ('Foo *bar\nbaz*\n====\n', '<h1>Foo <em>bar\nbaz</em></h1>\n'),
    ('Foo\n    ---\n', '<p>Foo\n---</p>\n'),
    ('Foo\n= =\n\nFoo\n--- -\n', '<p>Foo\n= =</p>\n<p>Foo</p>\n<hr />\n'),
    ('Foo  \n-----\n', '<h2>Foo</h2>\n'),
    ('Foo\\\n----\n', '<h2>Foo\\</h2>\n'),
    ('`Foo\n----\n`\n', '<h2>`Foo</h2>\n<p>`</p>\n'),
    ('> Foo\n---\n', '<blockquote>\n<p>Foo</p>\n</blockquote>\n<hr />\n'),
    ('> foo\nbar\n===\n', '<blockquote>\n<p>foo\nbar\n===</p>\n</blockquote>\n'),
    ('- Foo\n---\n', '<ul>\n<li>Foo</li>\n</ul>\n<hr />\n'),
    ('---\nFoo\n---\nBar\n---\nBaz\n', '<hr />\n<h2>Foo</h2>\n<h2>Bar</h2>\n<p>Baz</p>\n'),
    ('\n====\n', '<p>====</p>\n'),
    ('\\> foo\n------\n', '<h2>&gt; foo</h2>\n'),
    # indented
    ('  - foo\n\n    bar\n', '<ul>\n<li>\n<p>foo</p>\n<p>bar</p>\n</li>\n</ul>\n'),
    ('1.  foo\n\n    - bar\n', '<ol>\n<li>\n<p>foo</p>\n<ul>\n<li>bar</li>\n</ul>\n</li>\n</ol>\n'),
    ('    chunk1\n\n    chunk2\n  \n \n \n    chunk3\n', '<pre><code>chunk1\n\nchunk2\n\n\n\nchunk3\n</code></pre>\n'),
    ('    chunk1\n      \n      chunk2\n', '<pre><code>chunk1\n  \n  chunk2\n</code></pre>\n'),
    ('        foo\n    bar\n', '<pre><code>    foo\nbar\n</code></pre>\n'),
    ('\n    \n    foo\n    \n', '<pre><code>foo\n</code></pre>\n'),
    ('    foo  \n', '<pre><code>foo  \n</code></pre>\n'),
    # fences
    ('```\n<\n >\n```\n', '<pre><code>&lt;\n &gt;\n</code></pre>\n'),
    ('``\nfoo\n``\n', '<p><code>foo</code></p>\n'),
    ('```\naaa\n~~~\n```\n', '<pre><code>aaa\n~~~\n</code></pre>\n'),
    ('````\naaa\n```\n``````\n', '<pre><code>aaa\n```\n</code></pre>\n'),
    ('```\n', '<pre><code></code></pre>\n'),
    ('> ```\n> aaa\n\nbbb\n', '<blockquote>\n<pre><code>aaa\n</code></pre>\n</blockquote>\n<p>bbb</p>\n'),
    ('```\n\n  \n```\n', '<pre><code>\n  \n</code></pre>\n'),
    ('  ```\naaa\n  aaa\naaa\n  ```\n', '<pre><code>aaa\naaa\naaa\n</code></pre>\n'),
    ('   ```\n   aaa\n    aaa\n  aaa\n   ```\n', '<pre><code>aaa\n aaa\naaa\n</code></pre>\n'),
    ('```\naaa\n    ```\n', '<pre><code>aaa\n    ```\n</code></pre>\n'),
    ('``` ```\naaa\n', '<p><code> </code>\naaa</p>\n'),
    ('~~~~~~\naaa\n~~~ ~~\n', '<pre><code>aaa\n~~~ ~~\n</code></pre>\n'),
    ('foo\n```\nbar\n```\nbaz\n', '<p>foo</p>\n<pre><code>bar\n</code></pre>\n<p>baz</p>\n'),
    ('~~~~    ruby startline=3 $%@#$\ndef foo(x)\n~~~~~~~\n', '<pre><code class="language-ruby">def foo(x)\n</code></pre>\n'),
    ('``` aa ```\nfoo\n', '<p><code>aa</code>\nfoo</p>\n'),
    ('~~~ aa ``` ~~~\nfoo\n~~~\n', '<pre><code class="language-aa">foo\n</code></pre>\n'),
    # html
    (' <div>\n  *hello*\n         <foo><a>\n', ' <div>\n  *hello*\n         <foo><a>\n'),
    ('</div>\n*foo*\n', '</div>\n*foo*\n'),
    ('<DIV CLASS="foo">\n\n*Markdown*\n\n</DIV>\n', '<DIV CLASS="foo">\n<p><em>Markdown</em></p>\n</DIV>\n'),
    ('<del>\n*foo*\n</del>\n', '<del>\n*foo*\n</del>\n'),
    ('<del>*foo*</del>\n', '<p><del><em>foo</em></del></p>\n'),
    ('<!-- Foo\n\nbar\n   baz -->\nokay\n', '<!-- Foo\n\nbar\n   baz -->\n<p>okay</p>\n'),
    ("<?php\n\n  echo '>';\n\n?>\nokay\n", "<?php\n\n  echo '>';\n\n?>\n<p>okay</p>\n"),
    ('<!DOCTYPE html>\n', '<!DOCTYPE html>\n'),
    ('Foo\n<div>\nbar\n</div>\n', '<p>Foo</p>\n<div>\nbar\n</div>\n'),
    ('<style>p{color:red;}</style>\n*foo*\n', '<style>p{color:red;}</style>\n<p><em>foo</em></p>\n'),
    ('- <div>\n- foo\n', '<ul>\n<li>\n<div>\n</li>\n<li>foo</li>\n</ul>\n'),
    # link refs
    ('[foo]: /url "title"\n\n[foo]\n', '<p><a href="/url" title="title">foo</a></p>\n'),
    ("   [foo]: \n      /url  \n           'the title'  \n\n[foo]\n", '<p><a href="/url" title="the title">foo</a></p>\n'),
    ("[Foo*bar\\]]:my_(url) 'title (with parens)'\n\n[Foo*bar\\]]\n", '<p><a href="my_(url)" title="title (with parens)">Foo*bar]</a></p>\n'),
    ("[foo]: /url 'title\n\nwith blank line'\n\n[foo]\n", "<p>[foo]: /url 'title</p>\n<p>with blank line'</p>\n<p>[foo]</p>\n"),
    ('[foo]:\n\n[foo]\n', '<p>[foo]:</p>\n<p>[foo]</p>\n'),
    ('[foo]: <>\n\n[foo]\n', '<p><a href="">foo</a></p>\n'),
    ('[foo]: <bar>(baz)\n\n[foo]\n', '<p>[foo]: <bar>(baz)</p>\n<p>[foo]</p>\n'),
    ('[foo]: first\n[foo]: second\n\n[foo]\n', '<p><a href="first">foo</a></p>\n'),
    ('[ΑΓΩ]: /φου\n\n[αγω]\n', '<p><a href="/%CF%86%CE%BF%CF%85">αγω</a></p>\n'),
    ('[foo]: /url "title" ok\n', '<p>[foo]: /url &quot;title&quot; ok</p>\n'),
    ('[foo]: /url\n"title" ok\n', '<p>&quot;title&quot; ok</p>\n'),
    ('Foo\n[bar]: /baz\n\n[bar]\n', '<p>Foo\n[bar]: /baz</p>\n<p>[bar]</p>\n'),
    ('# [Foo]\n[foo]: /url\n> bar\n', '<h1><a href="/url">Foo</a></h1>\n<blockquote>\n<p>bar</p>\n</blockquote>\n'),
    ('[foo]: /url\n===\n[foo]\n', '<p>===\n<a href="/url">foo</a></p>\n'),
    ('[foo]\n\n> [foo]: /url\n', '<p><a href="/url">foo</a></p>\n<blockquote>\n</blockquote>\n'),
    # paragraphs
    ('  aaa\n bbb\n', '<p>aaa\nbbb</p>\n'),
    ('aaa     \nbbb     \n', '<p>aaa<br />\nbbb</p>\n'),
    ('    aaa\nbbb\n', '<pre><code>aaa\n</code></pre>\n<p>bbb</p>\n'),
    # quotes
    ('># Foo\n>bar\n> baz\n', '<blockquote>\n<h1>Foo</h1>\n<p>bar\nbaz</p>\n</blockquote>\n'),
    ('> bar\nbaz\n> foo\n', '<blockquote>\n<p>bar\nbaz\nfoo</p>\n</blockquote>\n'),
    ('> - foo\n- bar\n', '<blockquote>\n<ul>\n<li>foo</li>\n</ul>\n</blockquote>\n<ul>\n<li>bar</li>\n</ul>\n'),
    ('>     foo\n    bar\n', '<blockquote>\n<pre><code>foo\n</code></pre>\n</blockquote>\n<pre><code>bar\n</code></pre>\n'),
    ('> ```\nfoo\n```\n', '<blockquote>\n<pre><code></code></pre>\n</blockquote>\n<p>foo</p>\n<pre><code></code></pre>\n'),
    ('> foo\n    - bar\n', '<blockquote>\n<p>foo\n- bar</p>\n</blockquote>\n'),
    ('>\n', '<blockquote>\n</blockquote>\n'),
    ('>\n> foo\n>  \n', '<blockquote>\n<p>foo</p>\n</blockquote>\n'),
    ('> foo\n\n> bar\n', '<blockquote>\n<p>foo</p>\n</blockquote>\n<blockquote>\n<p>bar</p>\n</blockquote>\n'),
    ('> foo\n>\n> bar\n', '<blockquote>\n<p>foo</p>\n<p>bar</p>\n</blockquote>\n'),
    ('> > > foo\nbar\n', '<blockquote>\n<blockquote>\n<blockquote>\n<p>foo\nbar</p>\n</blockquote>\n</blockquote>\n</blockquote>\n'),
    ('>>> foo\n> bar\n>>baz\n', '<blockquote>\n<blockquote>\n<blockquote>\n<p>foo\nbar\nbaz</p>\n</blockquote>\n</blockquote>\n</blockquote>\n'),
    ('> bar\n\nbaz\n', '<blockquote>\n<p>bar</p>\n</blockquote>\n<p>baz</p>\n'),
    ('>     code\n\n>    not code\n', '<blockquote>\n<pre><code>code\n</code></pre>\n</blockquote>\n<blockquote>\n<p>not code</p>\n</blockquote>\n'),
    # list items
    ('1.  A paragraph\n    with two lines.\n\n        indented code\n\n    > A block quote.\n', '<ol>\n<li>\n<p>A paragraph\nwith two lines.</p>\n<pre><code>indented code\n</code></pre>\n<blockquote>\n<p>A block quote.</p>\n</blockquote>\n</li>\n</ol>\n'),
    ('- one\n\n two\n', '<ul>\n<li>one</li>\n</ul>\n<p>two</p>\n'),
    (' -    one\n\n     two\n', '<ul>\n<li>one</li>\n</ul>\n<pre><code> two\n</code></pre>\n'),
    ('   > > 1.  one\n>>\n>>     two\n', '<blockquote>\n<blockquote>\n<ol>\n<li>\n<p>one</p>\n<p>two</p>\n</li>\n</ol>\n</blockquote>\n</blockquote>\n'),
    ('-one\n\n2.two\n', '<p>-one</p>\n<p>2.two</p>\n'),
    ('- foo\n\n\n  bar\n', '<ul>\n<li>\n<p>foo</p>\n<p>bar</p>\n</li>\n</ul>\n'),
    ('123456789. ok\n', '<ol start="123456789">\n<li>ok</li>\n</ol>\n'),
    ('1234567890. not ok\n', '<p>1234567890. not ok</p>\n'),
    ('0. ok\n', '<ol start="0">\n<li>ok</li>\n</ol>\n'),
    ('003. ok\n', '<ol start="3">\n<li>ok</li>\n</ol>\n'),
    ('-1. not ok\n', '<p>-1. not ok</p>\n'),
    ('- foo\n\n      bar\n', '<ul>\n<li>\n<p>foo</p>\n<pre><code>bar\n</code></pre>\n</li>\n</ul>\n'),
    ('1.     indented code\n\n   paragraph\n\n       more code\n', '<ol>\n<li>\n<pre><code>indented code\n</code></pre>\n<p>paragraph</p>\n<pre><code>more code\n</code></pre>\n</li>\n</ol>\n'),
    ('-\n  foo\n-\n  ```\n  bar\n  ```\n-\n      baz\n', '<ul>\n<li>foo</li>\n<li>\n<pre><code>bar\n</code></pre>\n</li>\n<li>\n<pre><code>baz\n</code></pre>\n</li>\n</ul>\n'),
    ('-\n\n  foo\n', '<ul>\n<li></li>\n</ul>\n<p>foo</p>\n'),
    ('- foo\n-\n- bar\n', '<ul>\n<li>foo</li>\n<li></li>\n<li>bar</li>\n</ul>\n'),
    ('foo\n*\n\nfoo\n1.\n', '<p>foo\n*</p>\n<p>foo\n1.</p>\n'),
    ('  1.  A paragraph\nwith two lines.\n', '<ol>\n<li>A paragraph\nwith two lines.</li>\n</ol>\n'),
    ('> 1. > Blockquote\ncontinued here.\n', '<blockquote>\n<ol>\n<li>\n<blockquote>\n<p>Blockquote\ncontinued here.</p>\n</blockquote>\n</li>\n</ol>\n</blockquote>\n'),
    ('- foo\n  - bar\n    - baz\n      - boo\n', '<ul>\n<li>foo\n<ul>\n<li>bar\n<ul>\n<li>baz\n<ul>\n<li>boo</li>\n</ul>\n</li>\n</ul>\n</li>\n</ul>\n</li>\n</ul>\n'),
    ('- foo\n - bar\n  - baz\n   - boo\n', '<ul>\n<li>foo</li>\n<li>bar</li>\n<li>baz</li>\n<li>boo</li>\n</ul>\n'),
    ('10) foo\n    - bar\n', '<ol start="10">\n<li>foo\n<ul>\n<li>bar</li>\n</ul>\n</li>\n</ol>\n'),
    ('10) foo\n   - bar\n', '<ol start="10">\n<li>foo</li>\n</ol>\n<ul>\n<li>bar</li>\n</ul>\n'),
    ('- - foo\n', '<ul>\n<li>\n<ul>\n<li>foo</li>\n</ul>\n</li>\n</ul>\n'),
    ('1. - 2. foo\n', '<ol>\n<li>\n<ul>\n<li>\n<ol start="2">\n<li>foo</li>\n</ol>\n</li>\n</ul>\n</li>\n</ol>\n'),
    ('- # Foo\n- Bar\n  ---\n  baz\n', '<ul>\n<li>\n<h1>Foo</h1>\n</li>\n<li>\n<h2>Bar</h2>\nbaz</li>\n</ul>\n'),
    # lists
    ('- foo\n- bar\n+ baz\n', '<ul>\n<li>foo</li>\n<li>bar</li>\n</ul>\n<ul>\n<li>baz</li>\n</ul>\n'),
    ('1. foo\n2. bar\n3) baz\n', '<ol>\n<li>foo</li>\n<li>bar</li>\n</ol>\n<ol start="3">\n<li>baz</li>\n</ol>\n'),
    ('Foo\n- bar\n- baz\n', '<p>Foo</p>\n<ul>\n<li>bar</li>\n<li>baz</li>\n</ul>\n'),
    ('The number is\n14.  The\n', '<p>The number is\n14.  The</p>\n'),
    ('The number is\n1.  The\n', '<p>The number is</p>\n<ol>\n<li>The</li>\n</ol>\n'),
    ('- foo\n\n- bar\n\n\n- baz\n', '<ul>\n<li>\n<p>foo</p>\n</li>\n<li>\n<p>bar</p>\n</li>\n<li>\n<p>baz</p>\n</li>\n</ul>\n'),
    ('- foo\n- bar\n\n<!-- -->\n\n- baz\n', '<ul>\n<li>foo</li>\n<li>bar</li>\n</ul>\n<!-- -->\n<ul>\n<li>baz</li>\n</ul>\n'),
    ('- a\n - b\n  - c\n   - d\n    - e\n', '<ul>\n<li>a</li>\n<li>b</li>\n<li>c</li>\n<li>d\n- e</li>\n</ul>\n'),
    ('1. a\n\n  2. b\n\n    3. c\n', '<ol>\n<li>\n<p>a</p>\n</li>\n<li>\n<p>b</p>\n</li>\n</ol>\n<pre><code>3. c\n</code></pre>\n'),
    ('- a\n- b\n\n- c\n', '<ul>\n<li>\n<p>a</p>\n</li>\n<li>\n<p>b</p>\n</li>\n<li>\n<p>c</p>\n</li>\n</ul>\n'),
    ('* a\n*\n\n* c\n', '<ul>\n<li>\n<p>a</p>\n</li>\n<li></li>\n<li>\n<p>c</p>\n</li>\n</ul>\n'),
    ('- a\n- b\n\n  [ref]: /url\n- d\n', '<ul>\n<li>\n<p>a</p>\n</li>\n<li>\n<p>b</p>\n</li>\n<li>\n<p>d</p>\n</li>\n</ul>\n'),
    ('- a\n- ```\n  b\n\n\n  ```\n- c\n', '<ul>\n<li>a</li>\n<li>\n<pre><code>b\n\n\n</code></pre>\n</li>\n<li>c</li>\n</ul>\n'),
    ('- a\n  - b\n\n    c\n- d\n', '<ul>\n<li>a\n<ul>\n<li>\n<p>b</p>\n<p>c</p>\n</li>\n</ul>\n</li>\n<li>d</li>\n</ul>\n'),
    ('* a\n  > b\n  >\n* c\n', '<ul>\n<li>a\n<blockquote>\n<p>b</p>\n</blockquote>\n</li>\n<li>c</li>\n</ul>\n'),
    ('1. ```\n   foo\n   ```\n\n   bar\n', '<ol>\n<li>\n<pre><code>foo\n</code></pre>\n<p>bar</p>\n</li>\n</ol>\n'),
    ('* foo\n  * bar\n\n  baz\n', '<ul>\n<li>\n<p>foo</p>\n<ul>\n<li>bar</li>\n</ul>\n<p>baz</p>\n</li>\n</ul>\n'),
    # inlines
    ('`hi`lo`\n', '<p><code>hi</code>lo`</p>\n'),
    ('\\!\\"\\#\\$\\%\\&\\\'\\(\\)\\*\\+\\,\\-\\.\\/\\:\\;\\<\\=\\>\\?\\@\\[\\\\\\]\\^\\_\\`\\{\\|\\}\\~\n', "<p>!&quot;#$%&amp;'()*+,-./:;&lt;=&gt;?@[\\]^_`{|}~</p>\n"),
    ('\\\t\\A\\a\\ \\3\\φ\\«\n', '<p>\\\t\\A\\a\\ \\3\\φ\\«</p>\n'),
    ('\\\\*emphasis*\n', '<p>\\<em>emphasis</em></p>\n'),
    ('foo\\\nbar\n', '<p>foo<br />\nbar</p>\n'),
    ('`` \\[\\` ``\n', '<p><code>\\[\\`</code></p>\n'),
    ('<https://example.com?find=\\*>\n', '<p><a href="https://example.com?find=%5C*">https://example.com?find=\\*</a></p>\n'),
    ('[foo](/bar\\* "ti\\*tle")\n', '<p><a href="/bar*" title="ti*tle">foo</a></p>\n'),
    ('&nbsp; &amp; &copy; &AElig; &Dcaron;\n&frac34; &HilbertSpace; &DifferentialD;\n', '<p>\xa0 &amp; © Æ Ď\n¾ ℋ ⅆ</p>\n'),
    ('&#35; &#1234; &#992; &#0;\n', '<p># Ӓ Ϡ �</p>\n'),
    ('&#X22; &#XD06; &#xcab;\n', '<p>&quot; ആ ಫ</p>\n'),
    ('&nbsp &x; &#; &#x;\n&#87654321;\n&#abcdef0;\n&ThisIsNotDefined; &hi?;\n', '<p>&amp;nbsp &amp;x; &amp;#; &amp;#x;\n&amp;#87654321;\n&amp;#abcdef0;\n&amp;ThisIsNotDefined; &amp;hi?;</p>\n'),
    ('&copy\n', '<p>&amp;copy</p>\n'),
    ('[foo](/f&ouml;&ouml; "f&ouml;&ouml;")\n', '<p><a href="/f%C3%B6%C3%B6" title="föö">foo</a></p>\n'),
    ('&#42;foo&#42;\n*foo*\n', '<p>*foo*\n<em>foo</em></p>\n'),
    ('`` foo ` bar ``\n', '<p><code>foo ` bar</code></p>\n'),
    ('` `` `\n', '<p><code>``</code></p>\n'),
    ('`  ``  `\n', '<p><code> `` </code></p>\n'),
    ('` a`\n', '<p><code> a</code></p>\n'),
    ('``\nfoo \n``\n', '<p><code>foo </code></p>\n'),
    ('`foo   bar \nbaz`\n', '<p><code>foo   bar  baz</code></p>\n'),
    ('*foo`*`\n', '<p>*foo<code>*</code></p>\n'),
    ('[not a `link](/foo`)\n', '<p>[not a <code>link](/foo</code>)</p>\n'),
    ('`<a href="`">`\n', '<p><code>&lt;a href=&quot;</code>&quot;&gt;`</p>\n'),
    ('```foo``\n', '<p>```foo``</p>\n'),
    ('`foo``bar``\n', '<p>`foo<code>bar</code></p>\n'),
    ('a * foo bar*\n', '<p>a * foo bar*</p>\n'),
    ('a*"foo"*\n', '<p>a*&quot;foo&quot;*</p>\n'),
    ('foo*bar*\n', '<p>foo<em>bar</em></p>\n'),
    ('5*6*78\n', '<p>5<em>6</em>78</p>\n'),
    ('_ foo bar_\n', '<p>_ foo bar_</p>\n'),
    ('foo_bar_\n5_6_78\nпристаням_стремятся_\n', '<p>foo_bar_\n5_6_78\nпристаням_стремятся_</p>\n'),
    ('foo-_(bar)_\n', '<p>foo-<em>(bar)</em></p>\n'),
    ('_foo*\n', '<p>_foo*</p>\n'),
    ('*foo bar\n*\n', '<p>*foo bar\n*</p>\n'),
    ('*(*foo*)*\n', '<p><em>(<em>foo</em>)</em></p>\n'),
    ('_foo_bar_baz_\n', '<p><em>foo_bar_baz</em></p>\n'),
    ('foo**bar**\n', '<p>foo<strong>bar</strong></p>\n'),
    ('foo__bar__\n', '<p>foo__bar__</p>\n'),
    ('__foo, __bar__, baz__\n', '<p><strong>foo, <strong>bar</strong>, baz</strong></p>\n'),
    ('foo-__(bar)__\n', '<p>foo-<strong>(bar)</strong></p>\n'),
    ('**Gomphocarpus (*Gomphocarpus physocarpus*, syn.\n*Asclepias physocarpa*)**\n', '<p><strong>Gomphocarpus (<em>Gomphocarpus physocarpus</em>, syn.\n<em>Asclepias physocarpa</em>)</strong></p>\n'),
    ('*foo [bar](/url)*\n', '<p><em>foo <a href="/url">bar</a></em></p>\n'),
    ('_foo __bar__ baz_\n', '<p><em>foo <strong>bar</strong> baz</em></p>\n'),
    ('*foo *bar**\n', '<p><em>foo <em>bar</em></em></p>\n'),
    ('*foo**bar**baz*\n', '<p><em>foo<strong>bar</strong>baz</em></p>\n'),
    ('*foo**bar*\n', '<p><em>foo**bar</em></p>\n'),
    ('***foo** bar*\n', '<p><em><strong>foo</strong> bar</em></p>\n'),
    ('*foo**bar***\n', '<p><em>foo<strong>bar</strong></em></p>\n'),
    ('foo***bar***baz\n', '<p>foo<em><strong>bar</strong></em>baz</p>\n'),
    ('foo******bar*********baz\n', '<p>foo<strong><strong><strong>bar</strong></strong></strong>***baz</p>\n'),
    ('** is not an empty emphasis\n', '<p>** is not an empty emphasis</p>\n'),
    ('foo ***\n', '<p>foo ***</p>\n'),
    ('foo *\\**\n', '<p>foo <em>*</em></p>\n'),
    ('foo *_*\n', '<p>foo <em>_</em></p>\n'),
    ('**foo*\n', '<p>*<em>foo</em></p>\n'),
    ('*foo**\n', '<p><em>foo</em>*</p>\n'),
    ('****foo*\n', '<p>***<em>foo</em></p>\n'),
    ('**foo***\n', '<p><strong>foo</strong>*</p>\n'),
    ('__foo_\n', '<p>_<em>foo</em></p>\n'),
    ('****foo****\n', '<p><strong><strong>foo</strong></strong></p>\n'),
    ('***foo***\n', '<p><em><strong>foo</strong></em></p>\n'),
    ('_____foo_____\n', '<p><em><strong><strong>foo</strong></strong></em></p>\n'),
    ('*foo _bar* baz_\n', '<p><em>foo _bar</em> baz_</p>\n'),
    ('*foo __bar *baz bim__ bam*\n', '<p><em>foo <strong>bar *baz bim</strong> bam</em></p>\n'),
    ('**foo **bar baz**\n', '<p>**foo <strong>bar baz</strong></p>\n'),
    ('*foo *bar baz*\n', '<p>*foo <em>bar baz</em></p>\n'),
    ('*[bar*](/url)\n', '<p>*<a href="/url">bar*</a></p>\n'),
    ('*<img src="foo" title="*"/>\n', '<p>*<img src="foo" title="*"/></p>\n'),
    ('**a<https://foo.bar/?q=**>\n', '<p>**a<a href="https://foo.bar/?q=**">https://foo.bar/?q=**</a></p>\n'),
    # links
    ('[link]()\n', '<p><a href="">link</a></p>\n'),
    ('[link](</my uri>)\n', '<p><a href="/my%20uri">link</a></p>\n'),
    ('[link](foo\nbar)\n', '<p>[link](foo\nbar)</p>\n'),
    ('[a](<b)c>)\n', '<p><a href="b)c">a</a></p>\n'),
    ('[link](<foo\\>)\n', '<p>[link](&lt;foo&gt;)</p>\n'),
    ('[link](foo(and(bar)))\n', '<p><a href="foo(and(bar))">link</a></p>\n'),
    ('[link](foo(and(bar))\n', '<p>[link](foo(and(bar))</p>\n'),
    ('[link](foo\\)\\:)\n', '<p><a href="foo):">link</a></p>\n'),
    ('[link](foo\\bar)\n', '<p><a href="foo%5Cbar">link</a></p>\n'),
    ('[link](foo%20b&auml;)\n', '<p><a href="foo%20b%C3%A4">link</a></p>\n'),
    ('[link]("title")\n', '<p><a href="%22title%22">link</a></p>\n'),
    ('[link](/url "title "and" title")\n', '<p>[link](/url &quot;title &quot;and&quot; title&quot;)</p>\n'),
    ('[link](   /uri\n  "title"  )\n', '<p><a href="/uri" title="title">link</a></p>\n'),
    ('[link] (/uri)\n', '<p>[link] (/uri)</p>\n'),
    ('[link [foo [bar]]](/uri)\n', '<p><a href="/uri">link [foo [bar]]</a></p>\n'),
    ('[link] bar](/uri)\n', '<p>[link] bar](/uri)</p>\n'),
    ('[link [bar](/uri)\n', '<p>[link <a href="/uri">bar</a></p>\n'),
    ('[![moon](moon.jpg)](/uri)\n', '<p><a href="/uri"><img src="moon.jpg" alt="moon" /></a></p>\n'),
    ('[foo [bar](/uri)](/uri)\n', '<p>[foo <a href="/uri">bar</a>](/uri)</p>\n'),
    ('![[[foo](uri1)](uri2)](uri3)\n', '<p><img src="uri3" alt="[foo](uri2)" /></p>\n'),
    ('*[foo*](/uri)\n', '<p>*<a href="/uri">foo*</a></p>\n'),
    ('[foo *bar](baz*)\n', '<p><a href="baz*">foo *bar</a></p>\n'),
    ('[foo <bar attr="](baz)">\n', '<p>[foo <bar attr="](baz)"></p>\n'),
    ('[foo`](/uri)`\n', '<p>[foo<code>](/uri)</code></p>\n'),
    ('[foo][BaR]\n\n[bar]: /url "title"\n', '<p><a href="/url" title="title">foo</a></p>\n'),
    ('[foo]\n\n[bar][]\n\n[foo]: /f\n[bar]: /b\n', '<p><a href="/f">foo</a></p>\n<p><a href="/b">bar</a></p>\n'),
    ('[foo] [bar]\n\n[bar]: /url\n', '<p>[foo] <a href="/url">bar</a></p>\n'),
    ('[bar][foo\\!]\n\n[foo!]: /url\n', '<p>[bar][foo!]</p>\n'),
    ('[foo][ref\\[]\n\n[ref\\[]: /uri\n', '<p><a href="/uri">foo</a></p>\n'),
    ('[foo][bar][baz]\n\n[baz]: /url\n', '<p>[foo]<a href="/url">bar</a></p>\n'),
    ('[foo][bar][baz]\n\n[baz]: /url1\n[bar]: /url2\n', '<p><a href="/url2">foo</a><a href="/url1">baz</a></p>\n'),
    ('[[bar [foo]\n\n[foo]: /url\n', '<p>[[bar <a href="/url">foo</a></p>\n'),
    ('[foo](not a link)\n\n[foo]: /url1\n', '<p><a href="/url1">foo</a>(not a link)</p>\n'),
    ('\\[foo]\n\n[foo]: /url\n', '<p>[foo]</p>\n'),
    # images
    ('![foo *bar*][]\n\n[foo *bar*]: train.jpg "train & tracks"\n', '<p><img src="train.jpg" alt="foo bar" title="train &amp; tracks" /></p>\n'),
    ('![foo ![bar](/url)](/url2)\n', '<p><img src="/url2" alt="foo bar" /></p>\n'),
    ('My ![foo bar](/path/to/train.jpg  "title"   )\n', '<p>My <img src="/path/to/train.jpg" alt="foo bar" title="title" /></p>\n'),
    ('!\\[foo]\n\n[foo]: /url\n', '<p>![foo]</p>\n'),
    ('\\![foo]\n\n[foo]: /url\n', '<p>!<a href="/url">foo</a></p>\n'),
    # autolinks, html
    ('<MAILTO:FOO@BAR.BAZ>\n', '<p><a href="MAILTO:FOO@BAR.BAZ">MAILTO:FOO@BAR.BAZ</a></p>\n'),
    ('<https://foo.bar/baz bim>\n', '<p>&lt;https://foo.bar/baz bim&gt;</p>\n'),
    ('<foo@bar.example.com>\n', '<p><a href="mailto:foo@bar.example.com">foo@bar.example.com</a></p>\n'),
    ('<>\n', '<p>&lt;&gt;</p>\n'),
    ('<m:abc>\n', '<p>&lt;m:abc&gt;</p>\n'),
    ('https://example.com\n', '<p>https://example.com</p>\n'),
    ('<a><bab><c2c>\n', '<p><a><bab><c2c></p>\n'),
    ('x <a  /><b2\ndata="foo" >\n', '<p>x <a  /><b2\ndata="foo" ></p>\n'),
    ('<33> <__>\n', '<p>&lt;33&gt; &lt;__&gt;</p>\n'),
    ('x < a><\nfoo><bar/ >\n', '<p>x &lt; a&gt;&lt;\nfoo&gt;&lt;bar/ &gt;</p>\n'),
    ('foo <!-- this is a --\ncomment - with hyphens -->\n', '<p>foo <!-- this is a --\ncomment - with hyphens --></p>\n'),
    ('foo <!--> foo -->\n', '<p>foo <!--> foo --&gt;</p>\n'),
    ('foo <?php echo $a; ?>\n', '<p>foo <?php echo $a; ?></p>\n'),
    ('foo <![CDATA[>&<]]>\n', '<p>foo <![CDATA[>&<]]></p>\n'),
    ('foo <a href="\\*">\n', '<p>foo <a href="\\*"></p>\n'),
    ('foo  \n     bar\n', '<p>foo<br />\nbar</p>\n'),
    ('*foo  \nbar*\n', '<p><em>foo<br />\nbar</em></p>\n'),
    ('`code  \nspan`\n', '<p><code>code   span</code></p>\n'),
    ('foo\\\n', '<p>foo\\</p>\n'),
    ('### foo  \n', '<h3>foo</h3>\n'),
    ('foo \n baz\n', '<p>foo\nbaz</p>\n'),
    ('Multiple     spaces\n', '<p>Multiple     spaces</p>\n'),
]
DIFFERS = [
    ('<table><tr><td>\n<pre>\n**Hello**,\n\n_world_.\n</pre>\n</td></tr></table>\n', '<table><tr><td>\n<pre>\n**Hello**,\n<p><em>world</em>.\n</pre></p>\n</td></tr></table>\n'),
]

EXTENSIONS = [
    ('| foo | bar |\n| --- | --- |\n| baz | bim |\n', '<table>\n<thead>\n<tr>\n<th>foo</th>\n<th>bar</th>\n</tr>\n</thead>\n<tbody>\n<tr>\n<td>baz</td>\n<td>bim</td>\n</tr>\n</tbody>\n</table>\n'),
    ('| abc | defghi |\n:-: | -----------:\nbar | baz\n', '<table>\n<thead>\n<tr>\n<th style="text-align: center">abc</th>\n<th style="text-align: right">defghi</th>\n</tr>\n</thead>\n<tbody>\n<tr>\n<td style="text-align: center">bar</td>\n<td style="text-align: right">baz</td>\n</tr>\n</tbody>\n</table>\n'),
    ('| f\\|oo  |\n| ------ |\n| b `\\|` az |\n| b **\\|** im |\n', '<table>\n<thead>\n<tr>\n<th>f|oo</th>\n</tr>\n</thead>\n<tbody>\n<tr>\n<td>b <code>|</code> az</td>\n</tr>\n<tr>\n<td>b <strong>|</strong> im</td>\n</tr>\n</tbody>\n</table>\n'),
    ('| foo | bar |\n| --- | --- |\n| baz | bim |\n> x\n', '<table>\n<thead>\n<tr>\n<th>foo</th>\n<th>bar</th>\n</tr>\n</thead>\n<tbody>\n<tr>\n<td>baz</td>\n<td>bim</td>\n</tr>\n</tbody>\n</table>\n<blockquote>\n<p>x</p>\n</blockquote>\n'),
    ('| foo | bar |\n| --- | --- |\n| baz | bim |\n\nbar\n', '<table>\n<thead>\n<tr>\n<th>foo</th>\n<th>bar</th>\n</tr>\n</thead>\n<tbody>\n<tr>\n<td>baz</td>\n<td>bim</td>\n</tr>\n</tbody>\n</table>\n<p>bar</p>\n'),
    ('| abc | def |\n| --- |\n| bar |\n', '<p>| abc | def |\n| --- |\n| bar |</p>\n'),
    ('| foo | bar |\n| --- | --- |\n', '<table>\n<thead>\n<tr>\n<th>foo</th>\n<th>bar</th>\n</tr>\n</thead>\n</table>\n'),
    ('| abc | def |\n| --- | --- |\n| bar |\n| bar | baz | boo |\n', '<table>\n<thead>\n<tr>\n<th>abc</th>\n<th>def</th>\n</tr>\n</thead>\n<tbody>\n<tr>\n<td>bar</td>\n<td></td>\n</tr>\n<tr>\n<td>bar</td>\n<td>baz</td>\n</tr>\n</tbody>\n</table>\n'),
    ('- [ ] foo\n- [x] bar\n', '<ul class="contains-task-list">\n<li class="task-list-item"><input type="checkbox" disabled /> foo</li>\n<li class="task-list-item"><input type="checkbox" disabled checked /> bar</li>\n</ul>\n'),
    ('This ~~has a\n\nnew paragraph~~.\n', '<p>This ~~has a</p>\n<p>new paragraph~~.</p>\n'),
    ('This will ~~~not~~~ strike.\n', '<p>This will ~~~not~~~ strike.</p>\n'),
    ('www.commonmark.org\n', '<p><a href="http://www.commonmark.org">www.commonmark.org</a></p>\n'),
    ('Visit www.commonmark.org/help for more information.\n', '<p>Visit <a href="http://www.commonmark.org/help">www.commonmark.org/help</a> for more information.</p>\n'),
    ('Visit www.commonmark.org.\n', '<p>Visit <a href="http://www.commonmark.org">www.commonmark.org</a>.</p>\n'),
    ('www.google.com/search?q=Markup+(business)\n\n(www.google.com/search?q=Markup+(business))\n', '<p><a href="http://www.google.com/search?q=Markup+(business)">www.google.com/search?q=Markup+(business)</a></p>\n<p>(<a href="http://www.google.com/search?q=Markup+(business)">www.google.com/search?q=Markup+(business)</a>)</p>\n'),
    ('www.google.com/search?q=commonmark&hl;\n', '<p><a href="http://www.google.com/search?q=commonmark">www.google.com/search?q=commonmark</a>&amp;hl;</p>\n'),
    ('www.commonmark.org/he<lp\n', '<p><a href="http://www.commonmark.org/he">www.commonmark.org/he</a>&lt;lp</p>\n'),
    ('http://commonmark.org\n\n(Visit https://encrypted.google.com/search?q=Markup+(business))\n', '<p><a href="http://commonmark.org">http://commonmark.org</a></p>\n<p>(Visit <a href="https://encrypted.google.com/search?q=Markup+(business)">https://encrypted.google.com/search?q=Markup+(business)</a>)</p>\n'),
    ('foo@bar.baz\n', '<p><a href="mailto:foo@bar.baz">foo@bar.baz</a></p>\n'),
    ("hello@mail+xyz.example isn't valid, but hello+xyz@mail.example is.\n", '<p>hello@mail+xyz.example isn\'t valid, but <a href="mailto:hello+xyz@mail.example">hello+xyz@mail.example</a> is.</p>\n'),
    ('a.b-c_d@a.b\n\na.b-c_d@a.b.\n\na.b-c_d@a.b-\n\na.b-c_d@a.b_\n', '<p><a href="mailto:a.b-c_d@a.b">a.b-c_d@a.b</a></p>\n<p><a href="mailto:a.b-c_d@a.b">a.b-c_d@a.b</a>.</p>\n<p>a.b-c_d@a.b-</p>\n<p>a.b-c_d@a.b_</p>\n'),
]


def html(source):
    return re.sub(r'(<h[1-6]) id="[^"]*"', r"\1", HtmlRenderer(OPTIONS).render(parse(source, OPTIONS)))


@pytest.mark.parametrize("source, want", CASES)
def test_case(source, want):
    assert html(source) == want


@pytest.mark.parametrize("source, want", DIFFERS)
def test_known_difference(source, want):
    assert html(source) != want


def test_extension_cases():
    """Cases of the public specification of the GitHub flavour (fixed values); one tilde marks nothing here."""
    everything = Options.of("all", directives=False, roles=False)
    for source, want in EXTENSIONS:
        assert HtmlRenderer(everything).render(parse(source, everything)) == want
