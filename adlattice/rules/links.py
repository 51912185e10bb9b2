"""Marks of offer links in pages. All lists of this file are fixed values: classes, attributes,
patterns and hosts that the known link scans look for, in the order in which they apply."""

OFFER_CLASSES = ["offlink", "offer_link", "offerLink", "offer-link", "cta-link", "cta_link", "buy-link", "order-link", "checkout-link", "affiliate-link"]
DATA_ATTRS = ["data-offer", "data-href", "data-redirect-url", "data-offer-url", "data-link", "data-url", "data-target"]
SCRIPT_LINKS = [
    r"(?i)(?:var\s+|const\s+|let\s+)(?:offerUrl|offer_url|clickUrl|click_url|redirectUrl|redirectLink|outUrl|finalUrl|ctaUrl|destinationUrl)\s*[=:]\s*[\x22']?(https?://[^\x22';\s]+)",
    r"(?i)window\.offerUrl\s*=\s*[\x22']?(https?://[^\x22';\s]+)",
    r"(?i)(?:href|url)\s*:\s*[\x22']?(https?://[^\x22';\s,}]+)",
]
NETWORK_LINKS = [
    "hop.clickbank.net", "hop-apps.clickbank.net", "clickbank.com", "digistore24.com", "maxbounty.com", "shareasale.com", "awin1.com", "impactradius.com", "prf.hn", "linksynergy.com", "cj.com",
    "everad.com", "adcombo.com", "cpa.house", "mylead.global",
]
TRACKER_LINKS = ["prough-veridated.icu", "clktrkservices.com", "trkflstr.com", "trkerupper.com", "anti-aging.site"]
PARAM_LINKS = ["hop=", "hopId=", "aff_id=", "affid=", "affiliate_id=", "affiliate=", "offer_id=", "offid=", "oid=", "bf_lander=", "bf_offer=", "target_offer="]
#: Elements that hold an offer link, in order, as expressions on start tags.
SELECTORS = [
    r"(?i)^<a\s.*?\bclass\s*=\s*[\x22'][^\x22']*(?:offlink|offer_link|offerLink)",
    r"(?i)^<a\s.*?\bclass\s*=\s*[\x22'][^\x22']*offer-link",
    r"(?i)^<a\s.*?\bclass\s*=\s*[\x22'][^\x22']*cta-link",
    r"(?i)^<a\b.*?\sdata-offer\s*=",
    r"(?i)^<a\b.*?\sdata-href\s*=",
    r"(?i)\sdata-redirect-url\s*=",
    r"(?i)\sdata-offer-url\s*=",
]
#: Script variables that hold an offer link.
VARIABLES = [
    rf"{name}\s*[=:]\s*[\x22']?(https?://[^\x22';\s]+)"
    for name in (
        *(rf"var\s+{v}" for v in ("offerUrl", "offer_url", "clickUrl", "click_url", "redirectUrl", "redirect_url")),
        "offerLink", "offer_link", "clickLink", "outgoingUrl", "destinationUrl", "finalUrl", "ctaUrl",
    )
]
DEEP_SKIP = [
    "google-analytics", "googletagmanager", "doubleclick", "facebook.com/tr", "connect.facebook", "pixel", "analytics", "taboola.com", "outbrain.com", "prebid", "cookie", "sync", ".css", ".js", ".png", ".jpg",
    "cloudflare.com/cdn-cgi",
]
BOOSTS = [
    ("hop=", 5), ("hopid=", 5), ("aff_id=", 5), ("affid=", 5), ("offer_id=", 4), ("offid=", 4), ("oid=", 3), ("affiliate=", 4), ("checkout", 3), ("/vsl/", 3), ("/landers/", 3), ("/text.php", 3),
    ("clickbank", 5), ("digistore24", 5), ("bf_lander", 6), ("bf_offer", 6), ("melodyeu", 4),
]
#: Elements of the quick scan, as expressions on start tags.
QUICK_SELECTORS = [
    r"(?i)^<a\b.*?\sdata-offer\b",
    *(rf"(?i)\sclass\s*=\s*[\x22'][^\x22']*(?<![\w-]){c}(?![\w-])" for c in ("offer-link", "deal-link")),
    *(rf"(?i)\shref\s*=\s*[\x22'][^\x22']*{w}" for w in ("offer", "deal", "promo", "aff")),
    *(rf"(?i)\sclass\s*=\s*[\x22'][^\x22']*(?<![\w-]){c}(?![\w-])" for c in ("btn-offer", "affiliate-link", "product-link")),
    r"(?i)^<a\b.*?\shref\s*=\s*[\x22'][^\x22']*click",
    *(rf"(?i)\sclass\s*=\s*[\x22'][^\x22']*(?<![\w-]){c}(?![\w-])" for c in ("cta-button", "buy-button", "shop-now", "get-deal", "get-offer", "claim-btn", "claim-offer", "discount-link")),
]
QUICK_WORDS = ["offer", "deal", "promo", "aff", "click", "ref", "link", "product", "buy", "shop", "checkout", "cart", "order", "sale", "discount"]
