"""A second set of hand-written pages, written before the model that they test and not used to choose anything in it."""

MORE_PAGES = {
    "header and footer": (
        "<html><body><div id='site'><header class='site-header'><a href='/'>The Gazette</a></header><article><header><h1>Bridge opens early</h1></header><p>The new bridge over the estuary opened two weeks before the date that was planned.</p><p>Drivers were pleased. The ferry will stop in May.</p><footer>Published on 3 March</footer></article></div></body></html>",
        "Bridge opens early\n\nThe new bridge over the estuary opened two weeks before the date that was planned.\n\nDrivers were pleased. The ferry will stop in May.",
    ),
    "ends in links": (
        "<html><body><main><article><h1>Where to read about moss</h1><p>Moss grows on the north side of many things, and on the other sides too.</p><ul><li><a href='/a'>A short guide to moss</a></li><li><a href='/b'>Moss in gardens</a></li></ul></article></main><footer>&copy; Moss</footer></body></html>",
        "Where to read about moss\n\nMoss grows on the north side of many things, and on the other sides too.\n\nA short guide to moss\n\nMoss in gardens",
    ),
    "misleading names": (
        "<html><body><article class='post ad-free'><p class='comment-intro'>Many readers asked how the clock tower is wound.</p><p>It is done by hand, twice a week, by the same family since 1891.</p></article></body></html>",
        "Many readers asked how the clock tower is wound.\n\nIt is done by hand, twice a week, by the same family since 1891.",
    ),
    "one form around all": (
        "<html><body><form id='aspnetForm' method='post' action='page.aspx'><div class='menu'><a href='/1'>Home</a> <a href='/2'>Products</a> <a href='/3'>Contact</a></div><div id='content'><h1>Opening hours</h1><p>The library is open from nine to six. On Saturdays it closes at noon.</p></div></form></body></html>",
        "Opening hours\n\nThe library is open from nine to six. On Saturdays it closes at noon.",
    ),
    "nested comments": (
        "<html><body><article><h1>Tram line extended</h1><p>The tram will run to the stadium from next autumn, the council said on Tuesday.</p><p>Works begin in April.</p><section id='disqus_thread'><h2>12 comments</h2><div class='comment'><p>About time. I have waited for this for years, and so has everyone on my street.</p></div><div class='comment'><p>Who will pay for it? Not the stadium, I bet.</p></div><div class='comment'><p>Trams are slow. Buses would do as well and cost half.</p></div></section></article></body></html>",
        "Tram line extended\n\nThe tram will run to the stadium from next autumn, the council said on Tuesday.\n\nWorks begin in April.",
    ),
    "short heading": (
        "<html><body><nav><a href=/>Start</a> <a href=/t>Tools</a></nav><div class='entry-content'><h2>Planting garlic</h2><p>Break the bulb into cloves and plant them in October, a hand apart.</p><h3>Notes</h3><p>Water little. Too much of it rots the cloves.</p></div><div class='site-footer'>All rights reserved</div></body></html>",
        "Planting garlic\n\nBreak the bulb into cloves and plant them in October, a hand apart.\n\nNotes\n\nWater little. Too much of it rots the cloves.",
    ),
    "byline": (
        "<html><body><article><h1>A day at the docks</h1><p class='byline'>By Ada Moreno</p><p>The cranes start before the sun is up. By six the first containers are on trucks.</p></article><aside class='sidebar'><h3>Most read</h3><ul><li><a href='/x'>Port fees rise</a></li><li><a href='/y'>Ship runs aground</a></li></ul></aside></body></html>",
        "A day at the docks\n\nBy Ada Moreno\n\nThe cranes start before the sun is up. By six the first containers are on trucks.",
    ),
    "advert between": (
        "<html><body><div class='post-body'><p>Bread was baked in the square once a week. Every house brought its own dough.</p><div class='ad-slot'><p>Buy our knives. They cut everything.</p></div><p>The oven is still there, behind the church, and it is lit at Easter.</p></div></body></html>",
        "Bread was baked in the square once a week. Every house brought its own dough.\n\nThe oven is still there, behind the church, and it is lit at Easter.",
    ),
    "menu without a name": (
        "<html><body><div><a href='/1'>News</a> | <a href='/2'>Weather</a> | <a href='/3'>Traffic</a></div><div><h1>Snow in June</h1><p>Snow fell on the pass last night, for the first time in June since 1978.</p><p>The road is closed. It should open again on Thursday.</p></div></body></html>",
        "Snow in June\n\nSnow fell on the pass last night, for the first time in June since 1978.\n\nThe road is closed. It should open again on Thursday.",
    ),
    "figure and caption": (
        "<html><body><article><h1>The old mill</h1><figure><img src='mill.jpg'><figcaption>The mill seen from the river.</figcaption></figure><p>The mill ground corn until 1950. Now it holds a museum.</p></article><section class='related-posts'><h2>Related</h2><a href='/r'>Another mill</a></section></body></html>",
        "The old mill\n\nThe mill seen from the river.\n\nThe mill ground corn until 1950. Now it holds a museum.",
    ),
    "sign-up at the end": (
        "<html><body><main id='main'><h1>Repairing a puncture</h1><ol><li>Take off the wheel.</li><li>Find the hole with water.</li><li>Glue the patch and wait.</li></ol><div class='newsletter-signup'><p>Get our tips by mail each week.</p><form><input name='mail'></form></div></main></body></html>",
        "Repairing a puncture\n\nTake off the wheel.\n\nFind the hole with water.\n\nGlue the patch and wait.",
    ),
    "old tables": (
        "<html><body><table><tr><td><a href='a.html'>Home</a><br><a href='b.html'>Links</a></td><td><h1>My telescope</h1><p>I built it in the winter of 1997. The mirror took me four months to grind.</p><p>On clear nights it shows the rings of Saturn.</p></td></tr></table></body></html>",
        "My telescope\n\nI built it in the winter of 1997. The mirror took me four months to grind.\n\nOn clear nights it shows the rings of Saturn.",
    ),
    "questions": (
        "<html><body><header><nav><ul><li><a href='/'>Home</a></li><li><a href='/faq'>Questions</a></li></ul></nav></header><section class='content'><h1>Questions</h1><dl><dt>When do you open?</dt><dd>At eight, except on Mondays.</dd><dt>May I bring a dog?</dt><dd>Yes, if it is on a lead.</dd></dl></section><footer><p>Write to us.</p></footer></body></html>",
        "Questions\n\nWhen do you open?\n\nAt eight, except on Mondays.\n\nMay I bring a dog?\n\nYes, if it is on a lead.",
    ),
    "notice first": (
        "<html><body><div id='cookie-consent' role='dialog'><p>We use cookies to make the site better. You can change this at any time.</p><button>Fine</button></div><article class='story'><h2>Harvest ends</h2><p>The last grapes came in on Sunday. It was a good year, the growers say, and a dry one.</p></article></body></html>",
        "Harvest ends\n\nThe last grapes came in on Sunday. It was a good year, the growers say, and a dry one.",
    ),
}

#: A third set, written after the model was done and run once.
LAST_PAGES = {
    "sections": (
        "<html><body><header id='top'><a href='/'>Hill Farm</a></header><main><section><h2>Cheese</h2><p>We make three cheeses. All are from goat's milk.</p></section><section><h2>Bread</h2><p>Rye on Fridays, wheat on other days.</p></section></main><footer>Hill Farm, Upper Road</footer></body></html>",
        "Cheese\n\nWe make three cheeses. All are from goat's milk.\n\nBread\n\nRye on Fridays, wheat on other days.",
    ),
    "post with meta and share": (
        "<html><body><div class='site'><div class='main-nav'><ul><li><a href='/'>Home</a></li><li><a href='/about'>About</a></li></ul></div><div class='post'><h1 class='post-title'>Lost keys</h1><div class='post-content'><p>I lost my keys on the way to the station. A boy found them and ran after me.</p><p>Thank you, whoever you are.</p></div><ul class='share-buttons'><li><a href='#'>Mail</a></li><li><a href='#'>Print</a></li></ul></div></div></body></html>",
        "Lost keys\n\nI lost my keys on the way to the station. A boy found them and ran after me.\n\nThank you, whoever you are.",
    ),
    "replies as list": (
        "<html><body><article><h1>Rent rises again</h1><p>Rents in the old town rose by a tenth within a year, a survey found.</p></article><ol class='comment-list'><li class='comment'><p>Mine rose by a fifth. I will have to move.</p></li><li class='comment'><p>Where to? It is the same everywhere.</p></li></ol><div class='footer-widgets'><p>Contact us by mail.</p></div></body></html>",
        "Rent rises again\n\nRents in the old town rose by a tenth within a year, a survey found.",
    ),
    "code and table": (
        "<html><body><nav class='toc'><a href='#a'>Install</a> <a href='#b'>Use</a></nav><main><h1>Install</h1><p>Unpack the archive and run the script:</p><pre><code>sh install.sh</code></pre><table><tr><th>Option</th><th>Meaning</th></tr><tr><td>-q</td><td>Say nothing.</td></tr></table></main></body></html>",
        "Install\n\nUnpack the archive and run the script:\n\nsh install.sh\n\nOption\n\nMeaning\n\n-q\n\nSay nothing.",
    ),
    "search and login": (
        "<html><body><div id='header'><h1><a href='/'>City portal</a></h1><form id='search-form'><label>Search</label><input></form></div><div id='content'><h2>Waste collection</h2><p>Paper is collected on the first Monday of the month. Put it out before seven.</p></div><div id='login-box'><p>Log in to see your dates.</p></div></body></html>",
        "Waste collection\n\nPaper is collected on the first Monday of the month. Put it out before seven.",
    ),
    "one long paragraph": (
        "<html><body><p>" + "The ship left the harbour at dawn and turned to the south. " * 30 + "</p><div class='copyright'>&copy; 2011</div></body></html>",
        ("The ship left the harbour at dawn and turned to the south. " * 30).strip(),
    ),
}
