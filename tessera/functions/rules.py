"""Word lists and patterns the results depend on, in their natural order."""

DIRECTORY_HOSTS = (
    "dentee.com", "practo.com", "justdial.com", "sulekha.com", "indiamart.com", "tradeindia.com", "yellowpages.com",
    "facebook.com", "instagram.com", "linkedin.com", "twitter.com", "x.com", "vymaps.com", "lybrate.com",
    "clinicspots.com", "sehat.com", "apollo247.com", "wa.link", "bit.ly", "tinyurl.com", "linktr.ee", "calendly.com",
    "setmore.com", "beacons.ai",
)

EXCLUDED_HOSTS = (
    "facebook.com", "instagram.com", "linkedin.com", "youtube.com", "twitter.com", "x.com", "justdial.com", "sulekha.com",
    "indiamart.com", "tradeindia.com", "wikipedia.org", "glassdoor.com", "glassdoor.co.in", "naukri.com", "indeed.com",
    "foundit.in", "monster.com", "zoominfo.com", "crunchbase.com", "zaubacorp.com", "tofler.in", "ambitionbox.com",
    "practo.com", "lybrate.com", "magicbricks.com", "99acres.com", "housing.com", "jd.com", "justdial.in", "indiamart.in",
    "yellowpages.in", "yellowpages.com", "grotal.com", "asklaila.com", "hotfrog.in", "hotfrog.com",
)

SERP_EXCLUDED_HOSTS = (
    "facebook.com", "instagram.com", "linkedin.com", "youtube.com", "twitter.com", "x.com", "justdial.com", "sulekha.com",
    "indiamart.com", "tradeindia.com", "wikipedia.org", "glassdoor.com", "naukri.com", "indeed.com", "zoominfo.com",
    "crunchbase.com", "zaubacorp.com", "tofler.in", "practo.com", "lybrate.com", "magicbricks.com", "99acres.com",
    "grotal.com", "asklaila.com", "hotfrog.in", "hotfrog.com", "yellowpages.in", "yellowpages.com", "mouthshut.com",
    "quora.com", "reddit.com",
)

VERIFY_BLACKLIST = ("justdial", "sulekha", "practo", "indiamart", "facebook", "instagram")
FAKE_PHONES = ("1234567890", "0000000000", "9999999999")

EXTRACTED_REQUIRED = ("companyName", "website", "confidence")
EXTRACTED_BLACKLIST = (
    "justdial.com", "sulekha.com", "indiamart.com", "tradeindia.com", "wikipedia.org", "facebook.com", "instagram.com",
    "linkedin.com", "twitter.com", "youtube.com", "quora.com", "reddit.com", "glassdoor.com", "naukri.com", "indeed.com",
    "zoominfo.com", "yellowpages.in", "grotal.com", "asklaila.com", "hotfrog.com", "practo.com", "lybrate.com", "yelp.com",
    "zauba.com",
)

COUNTRY_SUFFIXES = ("india", "uk", "us", "usa", "uae")

PRODUCT_TERMS = (
    "crm", "analytics", "vault", "publish", "oneauth", "books", "creator", "mail", "desk", "assist", "campaign", "workflow",
    "automation", "platform", "product", "service", "solution", "suite", "cloud", "hub", "studio", "portal", "engine",
    "framework", "api", "sdk", "plugin", "setup", "guide", "install", "deploy", "configure", "integrate", "dashboard",
    "console", "admin", "panel", "module", "extension", "invoice", "inventory", "recruit", "survey", "connect", "cliq",
    "meeting", "webinar", "sign", "learn", "projects", "sprints", "bigin", "catalyst", "appsmith", "qengine", "orchestly",
    "directory", "app", "software", "tool", "system", "payment", "billing", "subscription", "enterprise", "professional",
    "premium", "ultimate", "basic", "starter",
)

REJECT_KEYWORDS = (
    "company", "agency", "services", "centre", "center", "foundation", "associates", "pvt ltd", "private limited", "group",
    "support", "info", "hello", "contact", "admin", "sales", "llc", "inc", "ltd", "limited", "corporation", "corp", "team",
    "office", "help", "no-reply", "noreply", "billing", "accounts", "systems", "technologies", "technology", "solutions",
    "networks", "ventures", "capital", "holdings", "industry", "industries", "enterprise", "enterprises", "partner",
    "partners", "consulting", "consultancy", "academy", "institute", "institutes", "university", "college", "school",
    "schools", "trust", "board", "council", "clinic", "clinics", "hospital", "hospitals", "dental", "medical", "healthcare",
    "care", "therapy", "therapies", "wellness", "studio", "studios", "lab", "labs", "hub", "hubs", "club", "clubs",
    "society", "association", "alliance", "network", "brand", "brands", "app", "apps", "application", "applications",
    "device", "devices", "hardware", "equipment", "material", "materials", "goods", "item", "items", "press", "media",
    "news", "blog", "forum", "channel", "channels", "publish", "publishing", "publication", "publications", "award",
    "awards", "prize", "prizes", "medal", "medals", "honour", "honours", "honor", "honors", "shri", "padma", "ratna",
    "nobel", "coach", "coaches", "coaching", "train", "trainer", "trainers", "training", "course", "courses", "class",
    "classes",
)

MARKETING_PHRASES = (
    "call now", "get started", "learn more", "read more", "contact us", "shop now", "buy now", "team member",
    "executive profiles", "apple fellow", "visit store", "book appointment", "book now", "start today", "free consultation",
    "click here", "our team", "about us", "find out more",
)

MENU_PHRASES = (
    "our story", "our doctors", "our clinics", "our team", "our services", "our partners", "our locations", "about us",
    "contact us", "learn more", "read more", "book appointment", "schedule appointment", "find a doctor", "find doctor",
    "meet our doctors", "know more", "explore more", "view all", "our treatments", "our specialties", "dental care",
    "mental health", "healthcare services", "our approach", "our mission", "our vision",
)

BUSINESS_SECTION_PHRASES = (
    "web development", "paid advertising", "content creation", "service area", "client outcomes", "how we win", "our origin",
    "case studies", "testimonials", "success stories", "frequently asked questions", "about us", "services",
    "precision over volume", "radical transparency", "products", "pricing", "solutions", "partners", "trusted partners",
    "features", "benefits", "why choose us", "our approach", "our process", "privacy policy",
)

CTA_PHRASES = ("click here", "buy now", "subscribe", "download", "get a quote", "sign up", "register")

DESCRIPTIVE_PHRASES = (
    "to help", "insights that", "our client", "we are", "helping you", "award on", "award—on", "on our", "for our", "from our",
)

EXECUTIVE_TITLES = (
    "founder", "co-founder", "cofounder", "ceo", "coo", "cto", "cfo", "cmo", "president", "vice president", "director", "vp",
    "head of", "head,", "managing director", "managing partner", "partner", "owner", "chairperson", "doctor", "dr.",
    "dentist", "psychiatrist", "psychologist", "consultant", "manager", "lead", "principal", "chief",
)

PROVEN_SECTIONS = (
    "TEAM_SECTION", "LEADERSHIP_SECTION", "PROFILE_CARD", "AUTHOR_CARD", "TESTIMONIAL_CARD", "FALLBACK_RELATIONSHIP_SCAN",
)

LARGE_COMPANY_HOSTS = ("apple.com", "google.com", "microsoft.com", "meta.com", "amazon.com", "samsung.com")

GENERIC_EMAILS = (
    "info", "support", "hello", "contact", "admin", "sales", "help", "enquiry", "enquiries", "noreply", "no-reply",
    "billing", "accounts", "hr", "careers", "jobs", "team", "office", "general", "mail", "webmaster", "postmaster",
    "marketing", "press", "media",
)

SOURCE_WEIGHTS = {
    "google_maps": 1.00, "website": 1.00, "ModernBERT": 0.95, "overpass": 0.90, "zauba": 0.90, "mca": 0.90, "gst": 0.88,
    "duckduckgo": 0.80, "google_dorks": 0.78, "NER": 0.75, "regex": 0.70, "indiamart_rss": 0.65, "sulekha": 0.60,
    "facebook": 0.55, "instagram": 0.50, "linkedin": 0.55, "wayback": 0.50, "grotal": 0.40, "asklaila": 0.40,
    "yellowpages": 0.40, "hotfrog": 0.40, "justdial": 0.40,
}

CANONICAL_INDUSTRY = {
    "dentist": "Healthcare", "dental": "Healthcare", "dental hospital": "Healthcare", "dental clinic": "Healthcare",
    "clinic": "Healthcare", "hospital": "Healthcare", "doctor": "Healthcare", "medical": "Healthcare",
    "pharmacy": "Healthcare", "healthcare": "Healthcare", "school": "Education", "college": "Education",
    "university": "Education", "coaching": "Education", "tuition": "Education", "education": "Education",
    "restaurant": "Food & Beverage", "cafe": "Food & Beverage", "hotel": "Hospitality", "resort": "Hospitality",
    "lawyer": "Legal", "advocate": "Legal", "law firm": "Legal", "legal": "Legal", "architect": "Architecture & Design",
    "interior designer": "Architecture & Design", "construction": "Construction", "real estate": "Real Estate",
    "property": "Real Estate", "gym": "Fitness & Wellness", "fitness": "Fitness & Wellness", "salon": "Beauty & Wellness",
    "spa": "Beauty & Wellness", "software": "Technology", "it services": "Technology", "technology": "Technology",
    "digital marketing": "Marketing", "marketing": "Marketing", "ca": "Financial Services",
    "chartered accountant": "Financial Services", "accountant": "Financial Services", "finance": "Financial Services",
    "insurance": "Financial Services", "manufacturer": "Manufacturing", "manufacturing": "Manufacturing",
    "wholesale": "Wholesale & Distribution", "distributor": "Wholesale & Distribution", "retailer": "Retail",
    "shop": "Retail", "store": "Retail", "transport": "Logistics & Transport", "logistics": "Logistics & Transport",
    "courier": "Logistics & Transport", "event": "Events & Entertainment", "wedding": "Events & Entertainment",
    "photography": "Events & Entertainment",
}

PAGE_PRIORITIES = {
    "contact": 100, "about": 95, "team": 95, "leadership": 95, "doctor": 95, "dentist": 95, "management": 95, "service": 90,
    "product": 90, "solution": 90, "pricing": 80, "appointment": 80, "book": 80, "career": 60, "blog": 60, "news": 60,
    "case-study": 60, "portfolio": 60, "faq": 60, "privacy": 5, "terms": 5,
}

TECH_SIGNATURES = {
    "WordPress": ("wp-content", "wp-includes", "wordpress"),
    "Wix": ("wix.com", "_wix_", "x-wix-published-version"),
    "Squarespace": ("squarespace.com", "static1.squarespace"),
    "Shopify": ("shopify.com", "cdn.shopify", "shopify.theme"),
    "Magento": ("magento", "mage.cookies"),
    "PrestaShop": ("prestashop",),
    "WooCommerce": ("woocommerce",),
    "React": ("__react_devtools", "_react", "react-dom"),
    "Angular": ("ng-version", "ng-app", "__ngcontext__"),
    "Vue.js": ("__vue__", "data-v-", "vue.min.js"),
    "Next.js": ("__next_data__", "_next/static"),
    "Bootstrap": ("bootstrap.min.css", "bootstrap.css"),
    "Tailwind": ("tailwind", "tw-"),
    "jQuery": ("jquery.min.js", "jquery-"),
    "Google Analytics": ("google-analytics.com", "gtag(", "ua-", "g-"),
    "Meta Pixel": ("facebook.net/en_us/fbevents", "fbq("),
    "HubSpot": ("hubspot.com", "hs-scripts"),
    "Zoho CRM": ("zoho.com", "zsalesiq"),
    "Freshdesk": ("freshdesk.com", "freshchat"),
    "Intercom": ("intercom.io", "intercomsettings"),
    "Drift": ("drift.com", "driftt.com"),
    "Zendesk": ("zendesk.com", "zd-", "zopim"),
    "Calendly": ("calendly.com",),
    "Razorpay": ("razorpay.com",),
    "PayU": ("payu.in", "payumoney"),
    "Stripe": ("stripe.com",),
    "Cloudflare": ("cloudflare",),
    "AWS CloudFront": ("cloudfront.net",),
    "Netlify": ("netlify",),
    "Vercel": ("vercel.app", "__vercel"),
}

SIGNAL_SIGNATURES = {
    "has_contact_form": ("<form", "contact-form", "contactform", "wpcf7", "cf7"),
    "has_whatsapp_widget": ("wa.me", "api.whatsapp.com", "whatsapp-button", "whatsappme"),
    "has_booking_system": (
        "calendly.com", "book-appointment", "booking.com", "simplybook", "bookmyshow", "acuityscheduling", "fresha.com",
        "practo.com/book", "bookingbutton", "appointment", "schedule-now",
    ),
    "has_crm_integration": (
        "hubspot.com", "zoho.com", "salesforce.com", "freshsales", "pipedrive.com", "crm", "leadform", "lead-form",
    ),
    "has_live_chat": ("tawk.to", "tidio.com", "freshchat", "intercom.io", "livechat.com", "drift.com", "crisp.chat"),
    "has_analytics": ("google-analytics.com", "gtag(", "ga(", "mixpanel.com", "segment.com", "hotjar.com", "clarity.ms"),
    "has_ecommerce": (
        "add-to-cart", "add_to_cart", "product", "shop", "store", "checkout", "buy-now", "woocommerce", "shopify",
    ),
    "has_newsletter": ("subscribe", "newsletter", "join our mailing list"),
    "has_careers": ("careers", "job openings", "apply now", "join our team"),
    "has_reviews": ("reviews", "testimonials", "what our clients say"),
    "has_faq": ("faq", "frequently asked questions"),
    "has_online_payments": ("checkout", "add to cart", "buy now", "stripe.com", "razorpay.com"),
}

SIZE_TIERS = (
    ("Enterprise", "1000+", ("enterprise", "fortune 500", "1000+ employees", "global offices", "publicly listed", "headquarters")),
    ("Mid-Market", "200-999", ("500 employees", "200 employees", "regional offices", "multiple locations", "nationwide")),
    ("SMB", "50-199", ("50 employees", "100 employees", "growing team", "expanding", "offices in")),
    ("Small Business", "1-49", ("small team", "family business", "local business", "boutique", "solo", "freelancer", "startup")),
)

LEADERSHIP_TITLES = (
    "founder", "co-founder", "ceo", "coo", "cto", "cfo", "cmo", "president", "vice president", "vp", "director",
    "managing director", "managing partner", "partner", "owner", "chairperson", "head of",
)

PROFILE_TITLES = (
    "ceo", "founder", "director", "manager", "president", "vp", "head", "doctor", "psychiatrist", "psychologist",
    "consultant", "principal", "owner", "partner", "chief",
)

EMAIL_PATTERN = r"\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b"
PHONE_PATTERN = (
    r"(?:\+?[0-9]{1,3}[\s\-.]?)?\(?[0-9]{3,5}\)?[\s\-.]?[0-9]{3,5}(?:[\s\-.]?[0-9]{3,5})?(?:\s?(?:ext|x)\.?\s?[0-9]{1,5})?"
)
WHATSAPP_PATTERN = r"(?:wa\.me|api\.whatsapp\.com/send\?phone=)[+/]?([0-9]{10,15})"
ADDRESS_PATTERN = (
    r"(?i)\b[0-9]+[,\s]+[a-z][a-z\s,\-]+(?:road|street|avenue|lane|nagar|colony|sector|block|phase|floor|building|tower|"
    r"plot|survey|flat)\b[^<]{0,150}"
)
SOCIAL_PATTERNS = {
    "facebook": r"""(?:https?://)?(?:www\.)?facebook\.com/(?!sharer)[^\s'"<>]+""",
    "instagram": r"""(?:https?://)?(?:www\.)?instagram\.com/[^\s'"<>]+""",
    "linkedin": r"""(?:https?://)?(?:www\.)?linkedin\.com/(?:company|in)/[^\s'"<>]+""",
    "twitter": r"""(?:https?://)?(?:www\.)?(?:twitter|x)\.com/[^\s'"<>]+""",
    "youtube": r"""(?:https?://)?(?:www\.)?youtube\.com/(?:c/|channel/|user/|@)[^\s'"<>]+""",
}
GSTIN_PATTERN = r"\b[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]\b"
CIN_PATTERN = r"[LU][0-9]{5}[A-Z]{2}[0-9]{4}[A-Z]{3}[0-9]{6}"
SNIPPET_PHONE_PATTERN = r"(?:\+91[\s\-]?)?(?:0[0-9]{2,4}[\s\-]?)?[0-9]{5}[\s\-]?[0-9]{5}"
