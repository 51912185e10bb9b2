"""Weighted signals of pages. All lists are fixed values, whole, in their known order: sums, ties
and samples depend on it. A set of rules is a list of (kind, fields, signals), where the
fields are the texts in which a signal counts, once however many hold it."""

OFFER_TYPES = [
    ("Affiliate/CPA", ["body", "html"], [
        ("order now", 4), ("rush my order", 4), ("yes! i want", 4), ("claim your", 3), ("limited time", 2), ("only x bottles", 3), ("60-day guarantee", 3), ("money back guarantee", 3),
        ("satisfaction guaranteed", 2), ("watch this video", 2), ("play video", 2), ("countdown", 2), ("timer", 1), ("expires", 2), ("supplement", 2), ("formula", 2), ("clinically", 2),
        ("clickbank", 3), ("hoplink", 3), ("affiliate", 2), ("aff_id", 3), ("these statements have not been evaluated", 3), ("fda has not evaluated", 3), ("individual results may vary", 2),
    ]),
    ("Dropshipping", ["body", "html"], [
        ("shopify", 4), ("cdn.shopify", 4), ("myshopify", 4), ("woocommerce", 4), ("wp-content/plugins/woocommerce", 5), ("bigcommerce", 4), ("add to cart", 3), ("add to bag", 3),
        ("shopping cart", 3), ("checkout", 2), ("in stock", 2), ("out of stock", 2), ("ships from", 2), ("free shipping", 2), ("quantity", 2), ("size", 1), ("color", 1), ("paypal", 2),
        ("stripe", 2), ("visa", 1), ("mastercard", 1), ("secure checkout", 2),
    ]),
    ("Arbitrage", ["html"], [
        ("taboola", 5), ("outbrain", 5), ("mgid", 4), ("adsbygoogle", 4), ("googlesyndication", 4), ("you might also like", 3), ("recommended for you", 3), ("sponsored", 2), ("next page", 2),
        ("comments", 1), ("share this", 1), ("by staff writer", 2), ("by admin", 1),
    ]),
    ("WordPress Blog", ["html", "url"], [
        ("/wp-content/", 5), ("/wp-includes/", 5), ("wordpress", 4), ("wp-json", 4), ("/category/", 3), ("/tag/", 2), ("posted by", 2), ("filed under", 2), ("leave a reply", 3), ("leave a comment", 3),
    ]),
    ("Lead Gen", ["body"], [
        ("enter your email", 3), ("get a free quote", 4), ("get a quote", 4), ("free consultation", 3), ("request a callback", 3), ("submit your info", 2), ("enter your zip", 3), ("enter zip code", 3),
        ("compare rates", 3), ("find your match", 2), ("how many employees", 2), ("what is your budget", 2),
    ]),
]

#: head: the title and the first 500 characters of the body.
VALIDITY = [
    ("tracking", ["title", "head"], [
        (w, 1) for w in (
            "just a moment", "please wait", "loading...", "redirecting", "checking your browser", "one moment", "almost there", "verifying you", "redirect", "tracking pixel",
            "this page intentionally left blank",
        )
    ]),
    ("offer", ["body"], [
        ("buy now", 3), ("order now", 3), ("add to cart", 3), ("get yours", 2), ("claim", 2), ("checkout", 3), ("limited offer", 2), ("special offer", 2), ("money back", 2), ("guarantee", 2),
        ("free shipping", 2), ("discount", 1), ("price", 1), ("buy", 1), ("shop", 1), ("$", 2), ("€", 2), ("£", 2), ("only $", 3), ("was $", 2), ("save ", 2),
    ]),
    ("arbitrage", ["html"], [
        ("taboola", 3), ("outbrain", 3), ("revcontent", 3), ("adsbygoogle", 3), ("googlesyndication", 3), ("you might also like", 2), ("sponsored content", 2), ("related articles", 2),
        ("continue reading", 1), ("next page", 2), ("slide", 1), ("/page/", 1),
    ]),
]

#: Marks of ad networks in a page; each is certain.
FINGERPRINTS = [
    ("Google AdSense/AdX", ["html"], [(w, 1) for w in ("adsbygoogle", "googlesyndication.com/pagead", "google_ad_client", 'ins class="adsbygoogle"')]),
    ("Taboola", ["html"], [(w, 1) for w in ("taboola-below-article", "taboola-right-rail", "data-taboola-placeholder", 'aria-label="image for taboola advertising unit"', 'class="trc_')]),
    ("Outbrain", ["html"], [(w, 1) for w in ("widgets.outbrain.com", "ob-widget", "data-ob-mark=", "outbrain-widget", 'aria-label="outbrain"')]),
    ("MGID", ["html"], [(w, 1) for w in ("mgid.com/widgets", "mgid-widget", "data-mgid-id")]),
    ("Revcontent", ["html"], [(w, 1) for w in ("trends.revcontent.com", "rc_widget", "data-revcontent")]),
]

ARBITRAGE = [
    ("url", ["url"], [("/trending/", 3), ("/article/", 2), ("/list/", 2), ("/gallery/", 2), ("/celebrities/", 3), ("/slideshow/", 3), ("/facts/", 2), ("/shocking/", 2), ("/around-the-web/", 3), ("/sponsored/", 3)]),
    ("content", ["html"], [
        ("you might also like", 2), ("related articles", 2), ("recommended for you", 2), ("next page", 3), ("sponsored content", 2), ("advertisement", 2), ("around the web", 2), ("read next", 1), ("continue reading", 2),
    ]),
]
