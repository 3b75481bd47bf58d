"""Pages written by hand, each with its main text: layouts that the labelled pages' generator doesn't make.

An entry is (name, page, the main text's blocks).  They are for measuring only; nothing is trained on them.
"""

LONG = ("The river rises in the hills behind the town and runs for ninety miles to the sea, through farms, woods and two small cities. "
        "In dry years its upper part is hardly more than a ditch, yet every few springs it leaves its bed.")
MORE = "People who live along it have kept records since 1804, when the first stone bridge was carried away."
LAST = "The next survey is planned for autumn, after the harvest has been brought in."

LAYOUTS = [
    ("table with a header row", f"<body><nav><a href=/>Home</a> <a href=/n>News</a></nav><article><h1>River levels</h1><p>{LONG}</p><table><thead><tr><th>Year</th><th>Level</th></tr></thead>"
     f"<tbody><tr><td>1990</td><td>3.2 m</td></tr><tr><td>1991</td><td>2.8 m</td></tr></tbody></table><p>{LAST}</p></article><footer>© River Post</footer></body>",
     ["River levels", LONG, "Year", "Level", "1990", "3.2 m", "1991", "2.8 m", LAST]),
    ("figure with a caption", f"<body><main><h1>The bridge</h1><p>{LONG}</p><figure><img src=a.jpg><figcaption>The old bridge in 1901, seen from the mill.</figcaption></figure><p>{MORE}</p></main></body>",
     ["The bridge", LONG, "The old bridge in 1901, seen from the mill.", MORE]),
    ("list of sources", f"<body><article><h1>Sources of the river</h1><p>{LONG}</p><p>{MORE}</p><h2>Sources</h2><ol><li><a href=/a>County archive, bridge accounts</a></li>"
     f"<li><a href=/b>Survey of the hills, 1899</a></li></ol></article><aside><h3>Most read</h3><ul><li><a href=/c>Weather</a></li></ul></aside></body>",
     ["Sources of the river", LONG, MORE, "Sources", "County archive, bridge accounts", "Survey of the hills, 1899"]),
    ("comments without names", f"<body><article><h1>Floods</h1><p>{LONG}</p><p>{MORE}</p></article><section><h3>3 Comments</h3><div><p>Great piece, I remember the flood of 1968 very well.</p></div>"
     "<div><p>My grandmother lived next to the mill, she told us about it.</p></div><div><p>Thanks!</p></div></section></body>", ["Floods", LONG, MORE]),
    ("comments inside the article", f"<body><article><h1>Floods</h1><p>{LONG}</p><p>{MORE}</p><section><h2>Comments (2)</h2><ul><li><p>So sad to see the old houses go.</p></li><li><p>When was this, exactly?</p></li></ul></section></article></body>",
     ["Floods", LONG, MORE]),
    ("advert without names", f"<body><article><h1>Floods</h1><p>{LONG}</p><div><a href=http://shop/x>Rain boots, 40% off this week only</a></div><p>{MORE}</p></article></body>", ["Floods", LONG, MORE]),
    ("advert with a label", f"<body><article><h1>Floods</h1><p>{LONG}</p><div><small>Advertisement</small><p>Buy the best rain boots in town. Free delivery.</p></div><p>{MORE}</p></article></body>", ["Floods", LONG, MORE]),
    ("plain divs", f"<body><div><a href=/>Home</a> | <a href=/n>News</a> | <a href=/c>Contact</a></div><div><h1>Floods</h1><div>{LONG}</div><div>{MORE}</div></div><div>Copyright 2020 River Post. All rights reserved.</div></body>", ["Floods", LONG, MORE]),
    ("layout table", f"<body><table><tr><td><a href=/>Home</a><br><a href=/n>News</a></td><td><h1>Floods</h1><p>{LONG}</p><p>{MORE}</p></td></tr></table></body>", ["Floods", LONG, MORE]),
    ("definition list", f"<body><article><h1>Words of the river</h1><p>{LONG}</p><dl><dt>Weir</dt><dd>A low wall across a river.</dd><dt>Ford</dt><dd>A place where one can walk through.</dd></dl></article></body>",
     ["Words of the river", LONG, "Weir", "A low wall across a river.", "Ford", "A place where one can walk through."]),
    ("code", f"<body><main><h1>Reading the gauge</h1><p>{LONG}</p><pre><code>level = read(gauge)</code></pre><p>{LAST}</p></main></body>", ["Reading the gauge", LONG, "level = read(gauge)", LAST]),
    ("quote", f"<body><article><h1>Floods</h1><p>{LONG}</p><blockquote><p>We lost everything but the piano.</p><footer>A farmer, 1968</footer></blockquote><p>{MORE}</p></article></body>", ["Floods", LONG, "We lost everything but the piano.", "A farmer, 1968", MORE]),
    ("sidebar first", f"<body><div class=sidebar><h3>About</h3><p>The River Post has been printed since 1880 and is read in every house along the river.</p></div><div class=content><h1>Floods</h1><p>{LONG}</p></div></body>", ["Floods", LONG]),
    ("related stories", f"<body><article><h1>Floods</h1><p>{LONG}</p><p>{MORE}</p><div><h4>Related stories</h4><ul><li><a href=/1>The mill is sold</a></li><li><a href=/2>New bridge opens</a></li></ul></div></article></body>", ["Floods", LONG, MORE]),
    ("newsletter box", f"<body><article><h1>Floods</h1><p>{LONG}</p><div><h4>Newsletter</h4><p>Get our stories every week.</p><form><input><button>Sign up</button></form></div><p>{MORE}</p></article></body>", ["Floods", LONG, MORE]),
    ("share row", f"<body><article><h1>Floods</h1><div><a href=/f>Facebook</a> <a href=/t>Twitter</a> <a href=/m>Mail</a></div><p>{LONG}</p></article></body>", ["Floods", LONG]),
    ("cookie bar", f"<body><div role=dialog><p>This site uses cookies to make it better for you.</p><button>Accept</button></div><main><h1>Floods</h1><p>{LONG}</p></main></body>", ["Floods", LONG]),
    ("captioned table", f"<body><article><h1>Levels</h1><p>{LONG}</p><table><caption>Highest levels since 1990</caption><tr><th>Place</th><td>Mill</td></tr></table></article></body>", ["Levels", LONG, "Highest levels since 1990", "Place", "Mill"]),
    ("nested lists", f"<body><article><h1>What to pack</h1><p>{LONG}</p><ul><li>Boots<ul><li>Rubber ones</li></ul></li><li>Rope</li></ul></article></body>", ["What to pack", LONG, "Boots", "Rubber ones", "Rope"]),
    ("short paragraphs", "<body><article><h1>Haiku</h1><p>Old pond.</p><p>A frog leaps in.</p><p>The sound of water.</p></article></body>", ["Haiku", "Old pond.", "A frog leaps in.", "The sound of water."]),
    ("links in prose", f"<body><article><h1>Floods</h1><p>See <a href=/a>the first part</a> and <a href=/b>the second part</a> of this story, which tells how it began.</p><p>{LONG}</p></article></body>",
     ["Floods", "See the first part and the second part of this story, which tells how it began.", LONG]),
    ("byline", f"<body><article><header><h1>Floods</h1><p>By Ana Mill, 3 May</p></header><p>{LONG}</p></article></body>", ["Floods", "By Ana Mill, 3 May", LONG]),
    ("site header", f"<body><header><h1>River Post</h1><p>News from the valley</p></header><article><h2>Floods</h2><p>{LONG}</p></article></body>", ["Floods", LONG]),
    ("breadcrumbs", f"<body><ol><li><a href=/>Home</a></li><li><a href=/n>News</a></li><li>Floods</li></ol><article><h1>Floods</h1><p>{LONG}</p></article></body>", ["Floods", LONG]),
    ("pages", f"<body><article><h1>Floods</h1><p>{LONG}</p></article><div><a href=/1>1</a> <a href=/2>2</a> <a href=/3>Next</a></div></body>", ["Floods", LONG]),
    ("log in", f"<body><div><form><p>Log in to read more</p><input><button>Log in</button></form></div><article><h1>Floods</h1><p>{LONG}</p><p>{MORE}</p></article></body>", ["Floods", LONG, MORE]),
    ("two sections", f"<body><main><section><h2>Before</h2><p>{LONG}</p></section><section><h2>After</h2><p>{MORE}</p></section></main><footer><ul><li><a href=/i>Imprint</a></li></ul></footer></body>", ["Before", LONG, "After", MORE]),
    ("questions", f"<body><main><h1>Questions</h1><h2>Is it safe?</h2><p>{LONG}</p><h2>Who pays?</h2><p>{MORE}</p></main></body>", ["Questions", "Is it safe?", LONG, "Who pays?", MORE]),
    ("reader replies", f"<body><div id=story><h1>Floods</h1><p>{LONG}</p><p>{MORE}</p></div><div><h2>What readers say</h2><ol><li><b>Ben</b> <p>I saw it too.</p></li><li><b>Cy</b> <p>Me too, and it was worse than that.</p></li></ol></div></body>", ["Floods", LONG, MORE]),
    ("aside note", f"<body><article><h1>Floods</h1><p>{LONG}</p><aside><p>Sign up for flood warnings by text message.</p></aside><p>{MORE}</p></article></body>", ["Floods", LONG, MORE]),
    ("tags", f"<body><article><h1>Floods</h1><p>{LONG}</p></article><p class=tags><a href=/r>river</a>, <a href=/f>flood</a></p></body>", ["Floods", LONG]),
    ("no markup but paragraphs", f"<h1>Floods</h1><p>{LONG}</p><p>{MORE}</p>", ["Floods", LONG, MORE]),
]
