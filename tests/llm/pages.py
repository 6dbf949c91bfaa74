"""Hand-written pages and the main text of each."""

PAGES = {
    'one': (
        '<html><body><article><p>The river rises in the hills. It reaches the sea in the west.</p></article></body></html>',
        'The river rises in the hills. It reaches the sea in the west.',
    ),
    'h1': (
        '<html><body><article><h1>Rivers</h1><p>The river rises in the hills. It reaches the sea in the west.</p></article></body></html>',
        'Rivers\n\nThe river rises in the hills. It reaches the sea in the west.',
    ),
    'threep': (
        '<html><body><p>One sentence here.</p><p>Another one there, a little longer.</p><p>And the last.</p></body></html>',
        'One sentence here.\n\nAnother one there, a little longer.\n\nAnd the last.',
    ),
    'quote': (
        '<html><body><article><p class="x>The river rises in the hills.</p><p class="y">It is long, and it reaches the sea.</p></article></body></html>',
        'The river rises in the hills.\n\nIt is long, and it reaches the sea.',
    ),
    'math': (
        '<html><body><article><p>Let <math>x</math> be a number, and <video>film</video> too.</p></article></body></html>',
        'Let x be a number, and film too.',
    ),
    'div': (
        '<html><head><title>t</title></head><body><div id=page><div class=row><h2>How to bake bread</h2><div>Take flour, water and salt. Mix them well.</div><div>Let the dough rest for an hour.</div></div></div></body></html>',
        'How to bake bread\n\nTake flour, water and salt. Mix them well.\n\nLet the dough rest for an hour.',
    ),
    'junk': (
        '<html><body><header><a href=/>Daily</a></header><nav><a href=/a>News</a> <a href=/b>Sport</a></nav><main><h1>Storm hits coast</h1><p>A storm hit the coast on Monday. Nobody was hurt.</p><p>The mayor spoke of luck.</p></main><aside><h3>Related</h3><ul><li><a href=/1>Old storm</a></li><li><a href=/2>New storm</a></li></ul></aside><footer>&copy; Daily 2020</footer></body></html>',
        'Storm hits coast\n\nA storm hit the coast on Monday. Nobody was hurt.\n\nThe mayor spoke of luck.',
    ),
    'short': (
        '<p>Hello.</p>',
        'Hello.',
    ),
    'bare': (
        'Just text without any markup at all, but two sentences. Here is the other.',
        'Just text without any markup at all, but two sentences. Here is the other.',
    ),
    'unclosedb': (
        '<body><article><p>First <b>bold text that nobody closes.<p>Second paragraph follows it. Fine.</article>',
        'First bold text that nobody closes.\n\nSecond paragraph follows it. Fine.',
    ),
    'button': (
        '<body><article><p>Press it. <button>OK<p>Then wait for the answer, which takes a while.</article>',
        'Press it.\n\nThen wait for the answer, which takes a while.',
    ),
    'list': (
        '<html><body><main><h1>Shopping</h1><ul><li>Milk</li><li>Bread and butter</li></ul><p>That is all we need today.</p></main></body></html>',
        'Shopping\n\nMilk\n\nBread and butter\n\nThat is all we need today.',
    ),
    'table': (
        '<html><body><article><h2>Prices</h2><p>The table shows prices in euros.</p><table><tr><th>Good</th><th>Price</th></tr><tr><td>Tea</td><td>3</td></tr></table></article><footer><a href=/i>Imprint</a></footer></body></html>',
        'Prices\n\nThe table shows prices in euros.\n\nGood\n\nPrice\n\nTea\n\n3',
    ),
    'comments': (
        "<html><body><div class=story><p>The council met on Friday. It agreed on the budget after a long debate, as it does every year.</p></div><div id=comments><h3>Comments</h3><div class=comment><p>I don't like it. Too much money.</p></div></div></body></html>",
        'The council met on Friday. It agreed on the budget after a long debate, as it does every year.',
    ),
    'cookie': (
        "<html><body><div class='cookie-banner'>We use cookies. <button>Accept</button></div><div><p>Bees live in hives. A hive has one queen, many workers and some drones.</p><p>Honey is their winter food.</p></div></body></html>",
        'Bees live in hives. A hive has one queen, many workers and some drones.\n\nHoney is their winter food.',
    ),
    'pre': (
        '<html><body><article><h1>Code</h1><p>Run this:</p><pre>make   all\n</pre><p>It takes a minute.</p></article></body></html>',
        'Code\n\nRun this:\n\nmake all\n\nIt takes a minute.',
    ),
    'blog': (
        '<html><body class=home><div id=top><a href=/>My blog</a></div><div class=entry><h1>On walking</h1><p>I walk each morning. It keeps me well, and I see the town wake up.</p><p>Yesterday it rained.</p></div><div class=sidebar><h4>Archive</h4><ul><li><a href=/2019>2019</a></li><li><a href=/2020>2020</a></li></ul></div></body></html>',
        'On walking\n\nI walk each morning. It keeps me well, and I see the town wake up.\n\nYesterday it rained.',
    ),
    'quote block': (
        '<html><body><article><p>She said it plainly:</p><blockquote>Nobody leaves before the work is done.</blockquote><p>And nobody left that night.</p></article></body></html>',
        'She said it plainly:\n\nNobody leaves before the work is done.\n\nAnd nobody left that night.',
    ),
    'linked words': (
        '<html><body><main><p>The <a href=/r>river</a> runs through the <a href=/t>town</a> and then on to the sea.</p></main><nav><a href=/1>One</a> <a href=/2>Two</a></nav></body></html>',
        'The river runs through the town and then on to the sea.',
    ),
    'newsletter': (
        '<html><body><article><h2>Tea</h2><p>Tea is made with hot water. Let it stand for three minutes.</p><form class=newsletter><label>Mail</label><input><p>Subscribe to our letter.</p></form></article></body></html>',
        'Tea\n\nTea is made with hot water. Let it stand for three minutes.',
    ),
    'caps': (
        '<HTML><BODY><P ALIGN=center>All tags are upper case here. It is an old page.<P>Nothing is closed.</BODY></HTML>',
        'All tags are upper case here. It is an old page.\n\nNothing is closed.',
    ),
    'references': (
        '<html><body><p>Caf&eacute; &amp; bar &#8211; open &lt; ten &nbsp;hours.</p></body></html>',
        'Café & bar – open < ten hours.',
    ),
}
