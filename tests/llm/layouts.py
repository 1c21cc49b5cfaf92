"""Pages written by hand, in layouts that the trainer's generator doesn't make, each with the text that a reader would mark."""

P1 = "The harbour was rebuilt after the storm of 1953, and most of the old quay walls were kept. Engineers reused the granite blocks, which had come by barge from the north."
P2 = "Visitors can walk along the new pier in twenty minutes. It is open all year, but the lamps are lit only from October to March."
P3 = "A small museum in the former customs house shows models of the ships, letters of their crews, and a map on which every wreck is marked."
D1 = "Der Hafen wurde nach dem Sturm von 1953 neu gebaut, doch die alten Mauern blieben stehen. Die Ingenieure verwendeten den Granit wieder, der per Schiff gekommen war."
D2 = "Besucher gehen in zwanzig Minuten über die neue Mole. Sie ist das ganze Jahr geöffnet, die Lampen brennen aber nur von Oktober bis März."
F1 = "Le port fut reconstruit après la tempête de 1953, mais on garda presque tous les vieux murs. Les ingénieurs reprirent les blocs de granit, venus du nord par bateau."
F2 = "On parcourt la nouvelle jetée en vingt minutes. Elle est ouverte toute l'année, mais les lampes ne brûlent que d'octobre à mars."

LAYOUTS = [
    # no classes at all: a list of links, three paragraphs, a line of small print
    (f"<html><body><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li><li><a href=/c>Contact</a></li></ul><div><h1>The harbour</h1><p>{P1}</p><p>{P2}</p><p>{P3}</p></div><footer>All rights reserved</footer></body></html>", ["The harbour", P1, P2, P3]),
    # German, roles instead of classes
    (f'<body><div role="navigation"><a href=/>Start</a> <a href=/w>Wetter</a> <a href=/s>Sport</a></div><div role="main"><h1>Der Hafen</h1><p>{D1}</p><p>{D2}</p></div><div role="complementary"><h3>Mehr dazu</h3><ul><li><a href=/1>Fähren</a></li><li><a href=/2>Fische</a></li></ul></div></body>', ["Der Hafen", D1, D2]),
    # French, with comments nested in comments
    (f'<body><header><a href="/">Journal</a></header><main><article><h1>Le port</h1><p>{F1}</p><p>{F2}</p></article><section id="comments"><h2>Vos avis</h2><article class="comment"><p>Très bel article, merci.</p><div class="replies"><article class="comment"><p>Je suis du même avis.</p></article></div></article></section></main></body>', ["Le port", F1, F2]),
    # a blog of its time: tables for layout
    (f'<body><table><tr><td><a href=/a>Archive</a><br><a href=/b>Links</a><br><a href=/c>About me</a></td><td><h2>The harbour</h2><p>{P1}</p><p>{P2}</p></td></tr></table></body>', ["The harbour", P1, P2]),
    # a figure with its caption, a quotation and a list inside the article
    (f'<body><article><h1>The harbour</h1><p>{P1}</p><figure><img src=q.jpg><figcaption>The quay in 1960, seen from the tower</figcaption></figure><blockquote><p>{P2}</p></blockquote><ul><li>Open from nine to five, every day</li><li>Tickets are sold at the gate</li></ul></article></body>', ["The harbour", P1, "The quay in 1960, seen from the tower", P2, "Open from nine to five, every day", "Tickets are sold at the gate"]),
    # an advert and a box of links between the paragraphs
    (f'<body><div class="post"><h1>The harbour</h1><p>{P1}</p><div class="ad-slot">Buy two lamps and pay for one!</div><p>{P2}</p><aside><h4>Read also</h4><a href=/x>Ferries of the north</a></aside><p>{P3}</p></div></body>', ["The harbour", P1, P2, P3]),
    # consent, newsletter, share buttons
    (f'<body><div id="cookie-banner"><p>We use cookies to give you the best experience.</p><button>Accept</button></div><main><h1>The harbour</h1><div class="share-buttons"><a href=#>Post</a> <a href=#>Send</a></div><p>{P1}</p><p>{P2}</p><form class="newsletter-signup"><p>Get our letter every week.</p><input name=e><button>Subscribe</button></form></main></body>', ["The harbour", P1, P2]),
    # deep wrappers with names that say nothing
    (f'<body><div class="x1"><div class="x2"><div class="x3"><div class="x4"><p>{P1}</p><p>{P2}</p></div></div></div></div><div class="x9"><a href=/1>one</a><a href=/2>two</a><a href=/3>three</a><a href=/4>four</a></div></body>', [P1, P2]),
    # formulas belong to the sentence
    (f'<body><nav><a href=/>Home</a></nav><article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be the depth of the harbour at low tide, in metres.</p><p>{P1}</p></article></body>', ["Let x=2 be the depth of the harbour at low tide, in metres.", P1]),
    # breadcrumbs, byline inside the article, related links after it
    (f'<body><ol class="breadcrumb"><li><a href=/>Home</a></li><li><a href=/t>Towns</a></li></ol><article><h1>The harbour</h1><p>{P1}</p><h2>The pier</h2><p>{P2}</p><h2>The museum</h2><p>{P3}</p></article><section class="related"><h3>More towns</h3><p><a href=/1>The island and its lighthouse</a></p><p><a href=/2>The bridge</a></p></section><footer><p>Harbour Times, printed since 1890.</p></footer></body>', ["The harbour", P1, "The pier", P2, "The museum", P3]),
]
