"""Pages written by hand, with the text that is theirs: (html, blocks). None of them comes from the training pages' rules."""

P1 = "The ferry leaves the old harbour at seven and reaches the island before noon. In winter it runs twice a week, and only if the wind allows it."
P2 = "Most visitors come for the lighthouse, which was built in 1854 by a family of masons. Its lamp was replaced three times; the last keeper left in 1981."
P3 = "We walked along the north shore, past the salt pans and the ruined mill. Nobody spoke for a while. The sea was loud enough."
P4 = "Bring water, a hat and good shoes, since there is no shop beyond the village. The path is marked with white stones."
NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/about">About us</a></li><li><a href="/contact">Contact</a></li></ul></nav>'
FOOT = "<footer>&copy; 2024 Harbour Times. All rights reserved.</footer>"
STEPS = ["Beat the eggs.", "Add the flour.", "Stir.", "Bake for 40 minutes.", "Let it cool."]
GOODS = ["8 cups of flour", "2 eggs", "1 pinch of salt", "butter"]


def lis(items):
    return "".join(f"<li>{x}</li>" for x in items)


PAGES = [
    # Lists of short items within articles.
    (f"<article><h1>Island bread</h1><p>{P1}</p><ul>{lis(GOODS)}</ul><p>{P2}</p></article>", ["Island bread", P1, *GOODS, P2]),
    (f"<body>{NAV}<article><h2>Steps</h2><ul>{lis(f'Step {i}: do the thing.' for i in range(5))}</ul></article>{FOOT}</body>", ["Steps", *[f"Step {i}: do the thing." for i in range(5)]]),
    (f"<body>{NAV}<main><h1>Island bread</h1><ol>{lis(STEPS)}</ol></main>{FOOT}</body>", ["Island bread", *STEPS]),
    (f"<html><body><div id=nav><a href=/>Home</a> | <a href=/a>Archive</a></div><div id=content><h1>Packing list</h1><p>{P4}</p><ul>{lis(['hat', 'water', 'good shoes', 'map'])}</ul></div><div id=footer>Copyright 2020</div></body></html>",
     ["Packing list", P4, "hat", "water", "good shoes", "map"]),
    (f"<article><p>{P1}</p><dl><dt>Length</dt><dd>9 km</dd><dt>Height</dt><dd>120 m</dd></dl><p>{P3}</p></article>", [P1, "Length", "9 km", "Height", "120 m", P3]),
    # Plain boxes under names that say nothing.
    (f'<body><div class="x1"><div class="q7">{P1}</div><div class="q7">{P2}</div><div class="q7">{P3}</div></div></body>', [P1, P2, P3]),
    (f"<body><div>{P1}</div><div>{P2}</div><div>{P3}</div></body>", [P1, P2, P3]),
    (f'<body><div class="css-1dbjc4n"><div class="r-13awgt0"><a href="/">Home</a> <a href="/t">Topics</a> <a href="/s">Shop</a></div><div class="r-1oszu61"><div class="r-qvutc0">{P1}</div><div class="r-qvutc0">{P2}</div><div class="r-qvutc0">{P4}</div></div></div></body>', [P1, P2, P4]),
    (f'<body><div class="zz"><h1>The island</h1><div class="ab12">{P1}</div><div class="ab12">{P3}</div></div><div class="yy"><a href="/i">Imprint</a> <a href="/p">Privacy</a></div></body>', ["The island", P1, P3]),
    (f"<body><center><div>{P2}<br><br>{P3}</div></center></body>", [f"{P2} {P3}"]),
    # Layout tables.
    (f'<body><table><tr><td><a href="/">Home</a><br><a href="/about">About</a><br><a href="/links">Links</a></td><td><h1>The island</h1><p>{P1}</p><p>{P2}</p></td></tr></table></body>', ["The island", P1, P2]),
    (f'<body><table width=100%><tr><td colspan=2><img src=logo.gif></td></tr><tr><td valign=top><a href=/>Home</a><br><a href=/map>Map</a></td><td>{P1}<p>{P2}<p>{P3}</td></tr></table></body>', [P1, P2, P3]),
    (f'<body><table><tr><td><ul><li><a href="/1">Boats</a><li><a href="/2">Nets</a><li><a href="/3">Knots</a></ul></td><td><p>{P3}</p><p>{P4}</p></td></tr></table></body>', [P3, P4]),
    # Data tables within articles.
    (f"<article><h1>Ferries</h1><p>{P1}</p><table><tr><th>Day</th><th>Leaves</th></tr><tr><td>Monday</td><td>7:00</td></tr><tr><td>Friday</td><td>9:30</td></tr></table><p>{P3}</p></article>",
     ["Ferries", P1, "Day", "Leaves", "Monday", "7:00", "Friday", "9:30", P3]),
    # Menus, adverts, notices, forms, comments around an article.
    (f'<body><header><div class="logo">Harbour Times</div>{NAV}</header><div class="cookie-banner"><p>We use cookies to make this site better. Do you accept?</p><button>Yes</button></div><main><article><h1>To the island</h1><p>{P1}</p><p>{P2}</p></article></main><aside><h3>Related</h3><ul><li><a href="/r1">Ten best beaches</a></li><li><a href="/r2">Where to eat</a></li></ul></aside>{FOOT}</body>',
     ["To the island", P1, P2]),
    (f'<body>{NAV}<div class="post"><h1>To the island</h1><p>{P1}</p><div class="advert">Buy three nights, pay two. Book today!</div><p>{P3}</p></div><section id="comments"><h3>Comments</h3><div class="comment"><p>Great read, thank you for this. I was there last year.</p></div><div class="comment"><p>The ferry was late. Very late.</p></div></section>{FOOT}</body>',
     ["To the island", P1, P3]),
    (f'<body><div id="top-menu"><a href="/">Home</a><a href="/x">Sale</a></div><section class="entry"><h2>A walk</h2><p>{P3}</p><p>{P4}</p></section><form class="newsletter"><p>Get our letter every week.</p><input name=m><button>Subscribe</button></form></body>', ["A walk", P3, P4]),
    (f'<body>{NAV}<article><header><h1>A walk</h1></header><p>{P3}</p><blockquote><p>{P2}</p></blockquote><p>{P4}</p></article><div class="sidebar"><p>Popular this week.</p><ul><li><a href="/1">One</a></li></ul></div></body>', ["A walk", P3, P2, P4]),
    (f'<body><div class="wrapper"><div class="menu"><ul><li><a href="/">Start</a></li><li><a href="/b">Blog</a></li></ul></div><div class="main"><h1>Salt</h1><p>{P2}</p><h2>How it is made</h2><p>{P3}</p><pre>salt = sea - water</pre></div><div class="footer">Salt Works Ltd.</div></div></body>',
     ["Salt", P2, "How it is made", P3, "salt = sea - water"]),
    (f'<body><main><p>{P1}</p><p>Short one.</p><p>{P2}</p></main></body>', [P1, "Short one.", P2]),
    (f'<body><article><h1>Verse</h1><p>The sea, the sea<br>it never sleeps<br>and no one asks it why</p><p>{P3}</p></article>{FOOT}</body>', ["Verse", "The sea, the sea it never sleeps and no one asks it why", P3]),
    (f'<body><article><p>As <a href="/m">the masons</a> wrote: {P2}</p><p>{P1} See <a href="/x">the map</a>.</p></article></body>', [f"As the masons wrote: {P2}", f"{P1} See the map."]),
    (f'<body><article><figure><img src=a.jpg><figcaption>The lighthouse in 1901.</figcaption></figure><p>{P2}</p><p>{P3}</p></article>{FOOT}</body>', ["The lighthouse in 1901.", P2, P3]),
    (f'<body>{NAV}<main><h1>Questions</h1><h3>When does it leave?</h3><p>At seven.</p><h3>How long does it take?</h3><p>Five hours, if the wind allows it.</p><h3>May I bring a dog?</h3><p>Yes.</p></main>{FOOT}</body>',
     ["Questions", "When does it leave?", "At seven.", "How long does it take?", "Five hours, if the wind allows it.", "May I bring a dog?", "Yes."]),
    ("<body>" + NAV + FOOT + "</body>", []),
    (f"<p>{P1}</p>", [P1]),
    (f"<body><p>{P1}</p><script>var p = '<p>no</p>';</script><p>{P2}</p><noscript>Turn it on.</noscript></body>", [P1, P2]),
    ("<body><article><h1>渡轮</h1><p>渡轮七点离开旧港，中午之前到达岛上。冬天每周只有两班，而且要看风。</p><p>大多数游客是为了灯塔而来，它建于一八五四年。</p></article><div class='footer'>版权所有</div></body>",
     ["渡轮", "渡轮七点离开旧港，中午之前到达岛上。冬天每周只有两班，而且要看风。", "大多数游客是为了灯塔而来，它建于一八五四年。"]),
    (f'<body><div class="hdr"><a href="/">Blog</a></div><div class="c2"><p>{P1}</p><ul>{lis(GOODS)}</ul><p>{P4}</p></div><div class="c3"><p><a href="/t/1">Tag one</a>, <a href="/t/2">Tag two</a></p></div></body>', [P1, *GOODS, P4]),
    (f'<body><article><h1>Rules</h1><ol><li><p>{P4}</p></li><li><p>{P3}</p></li></ol></article><div class="promo"><p>Sail with us. From 99 only!</p></div>{FOOT}</body>', ["Rules", P4, P3]),
    (f'<body><div class="container"><div class="row"><div class="col-8"><h1>Mill</h1><p>{P3}</p><p>{P1}</p></div><div class="col-4 widget"><h4>Newest</h4><ul><li><a href="/n1">Boat race</a></li><li><a href="/n2">Fish soup</a></li></ul></div></div></div></body>', ["Mill", P3, P1]),
    (f'<body><article><h1>Tools</h1><p>You need:</p><ul><li>a knife</li><li>a rope</li></ul><p>{P2}</p><p>Then:</p><ol>{lis(STEPS)}</ol></article>{FOOT}</body>', ["Tools", "You need:", "a knife", "a rope", P2, "Then:", *STEPS]),
]
