"""Rule tables.  Fixed values: labels, patterns and word lists that decide the results, in rule order."""

from __future__ import annotations

# (name, pattern, ticker, hint)
ENTITIES = [
    ("TSMC", r"Taiwan Semiconductor Manufacturing|\bTSMC\b", "TSM", "manufacturer"),
    ("Samsung", r"\bSamsung\b", None, "manufacturer"),
    ("Intel", r"\bIntel\b(?! Corporation’s)", "INTC", None),
    ("GlobalFoundries", r"GlobalFoundries|GLOBALFOUNDRIES", "GFS", "manufacturer"),
    ("SK hynix", r"SK [Hh]ynix", None, "supplier"),
    ("Micron", r"\bMicron\b", "MU", "supplier"),
    ("Foxconn (Hon Hai)", r"Foxconn|Hon Hai", None, "manufacturer"),
    ("Pegatron", r"\bPegatron\b", None, "manufacturer"),
    ("Wistron", r"\bWistron\b", None, "manufacturer"),
    ("Quanta", r"\bQuanta Computer\b", None, "manufacturer"),
    ("Amkor", r"\bAmkor\b", "AMKR", "supplier"),
    ("ASE", r"Advanced Semiconductor Engineering|\bASE (Technology|Group)\b", "ASX", "supplier"),
    ("ASML", r"\bASML\b", "ASML", "supplier"),
    ("Applied Materials", r"Applied Materials", "AMAT", "supplier"),
    ("Lam Research", r"Lam Research", "LRCX", "supplier"),
    ("Broadcom", r"\bBroadcom\b", "AVGO", None),
    ("Qualcomm", r"\bQualcomm\b", "QCOM", None),
    ("Arm", r"\bArm Holdings\b|\bArm Limited\b|\bARM\b(?= (architecture|license))", "ARM", None),
    ("AMD", r"Advanced Micro Devices|\bAMD\b", "AMD", None),
    ("NVIDIA", r"\bNVIDIA\b", "NVDA", None),
    ("Apple", r"\bApple\b(?! Pay)", "AAPL", None),
    ("Microsoft", r"\bMicrosoft\b|\bAzure\b", "MSFT", None),
    ("Amazon / AWS", r"\bAmazon\b|Amazon Web Services|\bAWS\b", "AMZN", None),
    ("Alphabet / Google", r"\bAlphabet\b|\bGoogle\b", "GOOGL", None),
    ("Meta", r"\bMeta Platforms\b|\bMeta\b(?=,| and| or|’s)", "META", None),
    ("Oracle", r"\bOracle\b", "ORCL", None),
    ("Dell", r"\bDell\b", "DELL", None),
    ("HP", r"\bHP Inc\b|Hewlett[- ]Packard Enterprise|\bHPE\b", "HPQ", None),
    ("Lenovo", r"\bLenovo\b", None, None),
    ("Super Micro", r"Super Micro|Supermicro", "SMCI", None),
    ("IBM", r"\bIBM\b", "IBM", None),
    ("Cisco", r"\bCisco\b", "CSCO", None),
    ("Walmart", r"\bWalmart\b", "WMT", None),
    ("Costco", r"\bCostco\b", "COST", None),
    ("Target", r"\bTarget Corporation\b", "TGT", None),
    ("Home Depot", r"Home Depot", "HD", None),
    ("Best Buy", r"Best Buy", "BBY", None),
    ("AT&T", r"\bAT&T\b", "T", None),
    ("Verizon", r"\bVerizon\b", "VZ", None),
    ("T-Mobile", r"T-Mobile", "TMUS", None),
    ("Visa", r"\bVisa\b(?! (application|requirement))", "V", None),
    ("Mastercard", r"\bMastercard\b", "MA", None),
    ("McKesson", r"\bMcKesson\b", "MCK", "distributor"),
    ("Cencora", r"\bCencora\b|AmerisourceBergen", "COR", "distributor"),
    ("Cardinal Health", r"Cardinal Health", "CAH", "distributor"),
    ("Arrow Electronics", r"Arrow Electronics", "ARW", "distributor"),
    ("Avnet", r"\bAvnet\b", "AVT", "distributor"),
    ("Tesla", r"\bTesla\b", "TSLA", None),
    ("Boeing", r"\bBoeing\b", "BA", None),
    ("Lockheed Martin", r"Lockheed Martin", "LMT", None),
    ("RTX", r"\bRaytheon\b|RTX Corporation", "RTX", None),
    ("U.S. government", r"U\.S\. (federal )?[Gg]overnment|United States [Gg]overnment|U\.S\. Department of Defense|Department of Defense|\bDoD\b", None, "government"),
    ("Medicare / Medicaid", r"\bMedicare\b|\bMedicaid\b", None, "government"),
]
RELATIONS = [
    ("Manufacturer / supplier", r"manufactur|foundr|fabricat|\bwafers?\b|supplier|suppl(y|ies) (us|our|the)|sole[- ]source|single[- ]source|components?|assembl|packag|contract manufactur|we (purchase|procure|source|rely on)"),
    ("Customer", r"\bcustomers?\b|accounted for|of (our |total )?(net )?(revenue|sales)|sales to|revenue from|purchas(e|es|ed) (our|from us)"),
    ("Cloud / infrastructure", r"\bcloud\b|data cent(er|re)s?|hosting|infrastructure (provider|services)"),
    ("Distributor / channel", r"distributors?|distribution|resellers?|wholesal|retail partners?"),
    ("Partner", r"partner(s|ship)?|collaborat|alliance|joint venture|strategic (agreement|relationship)"),
    ("Competitor", r"\bcompet(e|es|itor|itors|ition|itive)\b"),
]
GEOGRAPHIES = [
    ("China", r"\bChina\b|\bPRC\b|Chinese"), ("Taiwan", r"\bTaiwan\b"), ("Hong Kong", r"Hong Kong"), ("Japan", r"\bJapan\b"), ("South Korea", r"South Korea|\bKorea\b"), ("India", r"\bIndia\b"),
    ("Israel", r"\bIsrael\b"), ("Vietnam", r"\bVietnam\b"), ("Malaysia", r"\bMalaysia\b"), ("Singapore", r"\bSingapore\b"), ("Mexico", r"\bMexico\b"), ("Canada", r"\bCanada\b"),
    ("Europe", r"\bEurope(an Union)?\b|\bEU\b"), ("United Kingdom", r"United Kingdom|\bU\.K\.\b"), ("Germany", r"\bGermany\b"), ("Ireland", r"\bIreland\b"), ("Russia / Ukraine", r"\bRussia\b|\bUkraine\b"),
    ("Middle East", r"Middle East|\bIsrael\b|\bSaudi\b|\bUAE\b"),
]
GEO_REASONS = [
    ("manufacturing / supply", r"manufactur|supplier|foundr|production|facilit|fab\b|assembl"), ("sales / customers", r"revenue|sales|customers|demand|market"),
    ("trade / geopolitics", r"export|tariff|sanction|tension|conflict|\bwar\b|geopolit|government|restrict"),
]
MACRO = [
    ("Interest rates", r"interest rates?"), ("Inflation", r"\binflation"), ("Currency / U.S. dollar", r"foreign currenc|exchange rates?|strengthening of the U\.S\. dollar|currency fluctuations"),
    ("Commodities / energy", r"commodit|oil prices|energy (prices|costs)|raw materials|\bcopper\b|\bsteel\b|aluminum|lithium"), ("Consumer spending", r"consumer (spending|demand|confidence)|discretionary spending"),
    ("Business / IT spending", r"(IT|technology|capital) (spending|expenditures?) (by|of) (our )?customers|enterprise spending|customers’ capital expenditures"),
    ("Economic cycle", r"recession|economic (downturn|slowdown|uncertainty)|macroeconomic"), ("Credit / financing", r"credit markets|access to (capital|financing)|borrowing costs|capital markets"), ("Industry cyclicality", r"\bcyclical|cyclicality"),
]
POLICY = [
    ("Export controls", r"export control|Entity List|Bureau of Industry and Security|\bBIS\b|export licen[cs]|Export Administration Regulations"),
    ("Tariffs & trade", r"\btariffs?\b|trade (war|restrictions|policy|tensions|barriers)|Section 301|anti-?dumping|countervailing"),
    ("Government contracts & procurement", r"government contracts?|U\.S\. government (customers|agencies|contracts)|Department of Defense|federal agencies|procurement"),
    ("Subsidies & incentives", r"CHIPS (and Science )?Act|subsid(y|ies)|government grants?|tax credits?|Inflation Reduction Act"),
    ("Antitrust & competition law", r"antitrust|competition (law|authorit)|Federal Trade Commission|\bFTC\b|Department of Justice|European Commission|\bSAMR\b|Digital Markets Act"),
    ("Sector regulation", r"\bFDA\b|Food and Drug Administration|\bFCC\b|\bFAA\b|\bFERC\b|\bEPA\b|privacy (law|regulation)s?|\bGDPR\b|data protection"),
    ("Tax policy", r"tax (law|legislation|reform)|global minimum tax|Pillar Two|\bOECD\b"), ("Defense & national security", r"defense (budget|spending)|national security"),
    ("Energy & climate policy", r"energy policy|emissions (regulation|standards)|climate (regulation|legislation)"), ("Healthcare policy", r"\bMedicare\b|\bMedicaid\b|drug pricing|reimbursement rates?"),
]
THEMES = [
    ("ai", r"\bAI\b|artificial intelligence|generative|accelerated computing|machine learning|large language model"), ("data_center", r"data cent(?:er|re)s?"), ("hyperscale", r"hyperscale|cloud service providers?|\bCSPs?\b"),
    ("quantum", r"\bquantum\b"), ("crypto", r"crypto|bitcoin|digital assets?"), ("ev", r"electric vehicles?|\bEVs?\b"), ("defense", r"\bdefen[cs]e\b|military|national security"), ("nuclear", r"\bnuclear\b|uranium|reactor"),
    ("semis", r"semiconductors?|wafers?|\bchips?\b"),
]
PCT_OF = r"(\d{1,3}(?:\.\d+)?)\s?%\s+of\s+(?:our\s+|the\s+company[’']s\s+)?(?:total\s+|net\s+|consolidated\s+|worldwide\s+)*(revenues?|net sales|sales|accounts receivable|receivables|purchases|inventory purchases)"
PCT_QUALIFIER = r"customer|distributor|reseller|partner|supplier|countr|region|outside the United States|United States|China|Taiwan|Europe|Asia|one of our|largest"
PCT_SUBJECT = r"Customer [A-Z]\b|\b(?:[Oo]ne|[Tt]wo|[Tt]hree|[Ff]our|[Aa]nother) (?:direct |indirect )?customers?|largest customers?|one distributor|distributors?|outside (of )?the United States|United States|China|Taiwan|Europe|Asia[- ]Pacific"
GOV_ENTITIES = [
    ("Trump administration", r"\bTrump\b|White House"), ("Biden administration", r"\bBiden\b"), ("U.S. Department of Commerce", r"Commerce Department|Department of Commerce|\bCommerce Secretary\b|Bureau of Industry and Security"),
    ("U.S. Treasury", r"\bTreasury\b"), ("USTR", r"\bUSTR\b|Trade Representative"), ("FTC", r"\bFTC\b|Federal Trade Commission"), ("U.S. Department of Justice", r"\bDOJ\b|Justice Department|Department of Justice"),
    ("SEC", r"\bSEC\b(?! filing)|Securities and Exchange Commission"), ("FDA", r"\bFDA\b|Food and Drug Administration"), ("Pentagon / DoD", r"Pentagon|Department of Defense|\bDoD\b|Department of War"),
    ("U.S. Congress", r"Congress|Senate|House (of Representatives|committee)|lawmakers"), ("European Commission / EU", r"European Commission|\bEU\b|Brussels"),
    ("China (government)", r"Beijing|China’s (commerce|regulator)|\bSAMR\b|\bMOFCOM\b|Chinese (government|regulators?)"), ("Federal Reserve", r"Federal Reserve|\bthe Fed\b"), ("Courts", r"\bcourt\b|\bjudge\b"),
]
MATTER_CATEGORIES = [
    ("Antitrust", r"antitrust|competition law|monopol|anti-competitive"), ("Accounting issue", r"restat|non-reliance|material weakness|accounting (irregularit|error)"), ("Fraud allegation", r"\bfraud"),
    ("Cybersecurity / data breach", r"cyber|data breach|ransomware|unauthorized access|security incident"), ("Product failure / recall", r"recall|defect|product liability"),
    ("Securities litigation", r"securities (class action|laws?|fraud)|shareholder (class action|lawsuit|derivative)|class action|derivative (action|lawsuit|complaint|suit)"), ("Executive misconduct", r"misconduct|harassment"),
    ("Bankruptcy / distress", r"bankrupt|chapter 11|going concern|delist|receivership"), ("Major layoffs / restructuring", r"layoff|job cuts|workforce reduction|restructuring|exit (or|and) disposal"),
    ("Environmental / operational", r"environmental|emissions|spill|explosion|outage|\bfire\b|contaminat"), ("Patent / IP litigation", r"patent|intellectual property|infring"),
    ("Government investigation", r"investigat|subpoena|civil investigative demand|\binquiry\b|\bprobe\b"), ("Regulatory action", r"\bfined?\b|penalt|consent (order|decree)|cease[- ]and[- ]desist|sanction"),
    ("Lawsuit", r"lawsuit|litigation|complaint|\bsued\b|\bsues\b|\bsuits?\b"),
]
MATTER_STATUS = [
    ("DISMISSED", r"\bdismiss(ed|es|al)\b|thrown out|\bdrops? (its |the |a )?(\w+ )?(lawsuit|suit|case|claims?)\b|withdr(ew|aws?) (its |the )?(lawsuit|suit|complaint)"), ("SETTLED", r"\bsettle(d|s|ment)\b"),
    ("JUDGMENT", r"\b(judgment|verdict|found liable|ruled against|ordered to pay|jury award)"), ("CHARGE", r"\b(charged|indicted|indictment|criminal charges?)\b"),
    ("REGULATORY ACTION", r"\b(fined|imposed a fine|penalty of|consent (order|decree)|cease[- ]and[- ]desist|enforcement action)\b"), ("RESOLVED", r"\b(resolve[sd]?|concluded (its|the) investigation|closed (its|the) investigation|no further action)\b"),
    ("LAWSUIT FILED", r"\b(filed (a |an )?(putative )?(lawsuit|complaint|suit|class action)|sued|sues|lawsuits?|class actions?|complaints?)\b"), ("INVESTIGATION", r"\b(investigat\w*|subpoena\w*|inquiry|probe|civil investigative demand)\b"),
    ("CONFIRMED INCIDENT", r"\b(breach|cyber ?attack|ransomware|recall(ed|s)?|outage|explosion|spill)\b"), ("ALLEGATION", r"\b(alleg\w*|accus\w*)\b"),
]
MATTER_SPECIFIC = r"\b(filed|captioned|plaintiffs?|defendants?|court of|district court|v\.\s|In re\b|subpoena|settlement agreement|investigation into|civil investigative demand|consent (order|decree))\b"
MATTER_BOILERPLATE = r"^\s*(From time to time|We may|We could|To prevent|This choice|Our (amended and restated )?(certificate|bylaws|charter))|choice[- ]of[- ]forum|exclusive forum"
METRICS = [
    ("Revenue", r"\b(total )?(net )?(revenues?|net sales|sales)\b"), ("Gross margin", r"gross margins?"), ("Operating margin", r"operating margins?"), ("Operating expenses", r"operating expenses"),
    ("EPS", r"(earnings|net income|net loss|loss) per (diluted )?share|\bEPS\b"), ("Capital expenditures", r"capital expenditures|\bcapex\b"), ("Free cash flow", r"free cash flow"), ("Tax rate", r"tax rate"),
]
EXPECTATION = r"\b(expect|expects|expected|anticipat\w*|outlook|guidance|forecast\w*|project(s|ed)?)\b"
MONEY = r"\$\s?(\d[\d,]*(?:\.\d+)?)\s*(billion|million)?"
WITHDRAWN = r"withdr(a|e)w(s|n|ing)? (its |our |the )?(financial )?(guidance|outlook)|suspend(s|ed|ing)? (its |our )?(guidance|outlook)"
OUTLOOK_HEADING, OUTLOOK_REACH = r"(?i)\n\s*(Outlook|Business Outlook|Financial Outlook|Guidance|Fiscal \d{4} Outlook)[^\n]{0,120}\n", 5000
QUARTERS = ["first", "second", "third", "fourth"]
PERIODS = {
    "fiscal quarter": r"(first|second|third|fourth) quarter of fiscal(?: year)? (\d{4})", "quarter": r"(first|second|third|fourth)[- ]quarter (?:of )?(\d{4})",
    "year": r"(?:full[- ]year|fiscal(?: year)?|for the year)\s*(\d{4})|(\d{4})\s*(?:full[- ]year|fiscal year)", "next": r"next quarter|the (upcoming|coming) quarter|current quarter",
}
GAAP_PAIR = r"GAAP and non-GAAP (gross margins?|operating expenses|operating margins?)[^.]*?(\$?\d[\d.,]*\s*(?:billion|million)?%?)\s+and\s+(\$?\d[\d.,]*\s*(?:billion|million)?%?),? respectively"
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
TEXT_DATE = "(" + "|".join(MONTHS) + r")\s+(\d{1,2},\s+)?(20\d\d|19\d\d)"
ITEM_MATTERS = {  # item code: (category, status)
    "1.05": ("Cybersecurity / data breach", "CONFIRMED INCIDENT"), "4.02": ("Accounting issue", "CONFIRMED INCIDENT"), "1.03": ("Bankruptcy / distress", "CONFIRMED INCIDENT"),
    "2.05": ("Major layoffs / restructuring", "CONFIRMED INCIDENT"), "3.01": ("Bankruptcy / distress", "REGULATORY ACTION"),
}
ADVERSE = (r"\b(lawsuits?|sued|sues|suing|class action|probes?|probing|investigat\w*|subpoena\w*|recalls?|recalled|breach|hack(ed)?|layoffs?|job cuts|fined|fines|penalt\w*|settles?|settled|settlement|"
           r"charged|indicted|antitrust (probe|suit|case|investigation|lawsuit)|accused|alleg\w*|whistleblower|restat\w*|outage)\b")
COMPETITION_HEADINGS, COMPETITION_REACH = ["Competition", "Competitive Landscape", "Our Competitors"], 4000
COMPANY_WORDS = ["inc", "corp", "corporation", "company", "holdings", "the", "group"]  # of a company's name, telling nothing
SECTIONS = {  # name: (heading, next heading, minimum length)
    "risk": (r"item\s*1a\.?\s*[\-–—:]?\s*risk\s+factors", r"item\s*1b\.?|item\s*1c\.?|item\s*2\.?\s*[\-–—:]?\s*properties", 3000),
    "business": (r"item\s*1\.?\s*[\-–—:]?\s*business\b", r"item\s*1a\.?\s*[\-–—:]?\s*risk", 400),
    "legal": (r"item\s*3\.?\s*[\-–—:]?\s*legal\s+proceedings", r"item\s*4\.?", 150),
}
SECTION_FALLBACK = (r"\brisk\s+factors\b", r"\bunresolved staff comments\b|\binformation on the company\b|\bproperties\b", 3000)
BUSINESS_TOPICS = [
    ("segments", r"\b(segments?|operates (in|through) (two|three|four|five|\w+) |divisions?)\b"), ("customers", r"\b(customers?|clients?|serves|sells? (\w+ ){0,3}(to|through)|sold (to|through)|end users?)\b"),
    ("partnerships", r"\b(partner(ship)?s?|collaborat\w+|alliances?|joint venture|agreements? with)\b"),
    ("products", r"\b(products?|offers?|offerings?|provides?|platforms?|services|solutions|designs?|develops?|manufactures?|sells?|software|hardware|devices?|systems?)\b"),
]

# --- news ----------------------------------------------------------------------------------------------
OWNERSHIP = (r"((acquires|buys|sells|purchases|sold|bought|acquired|trims|adds) [\d,.]+ shares|shares (acquired|sold|bought|purchased) by|"
             r"(cuts|raises|boosts|lowers|trims|increases|decreases|reduces|grows|lifts) (its )?(stake|position|holdings)|position in|holdings in|stake in|\b13f\b|institutional (investor|ownership))")
LISTICLE = (r"(\b\d+ (stocks|reasons|things)\b|stocks? to (buy|watch|own)|should you buy|buy (now|today)|is it (a buy|too late)|better buy|top picks|millionaire|trending stock|facts to know|what you should know|"
            r"(dips|rises|falls) more than broader market)")
NEWS_CATEGORIES = [
    ("Earnings", r"\b(earnings|quarterly results|results|revenue|eps|profit|guidance|beats?|miss(es|ed)?|outlook|q[1-4]|fiscal (year|quarter))\b"),
    ("M&A", r"\b(acquires|acquisition|merger|merge|buyout|takeover|deal to buy|to acquire|divest(s|iture)?|spin[- ]?off)\b"),
    ("Legal", r"\b(lawsuit|sued|sues|class action|settle(ment|s)?|verdict|jury|litigation|patent (suit|infringement))\b"),
    ("Regulatory", r"\b(regulator|antitrust|ftc|doj|sec (charges|probe|investigation)|probe|investigation|fine[ds]?|fda|fcc)\b"),
    ("Government & Policy", r"\b(tariffs?|export (controls?|restrictions?|ban)|white house|administration|executive order|congress|senate|lawmakers|subsid(y|ies)|chips act|sanctions?|government|pentagon|department of (defense|commerce|energy|war)|federal|trump|commerce department|darpa)\b"),
    ("Contracts", r"\b(contract|awarded|wins? (deal|order)|order from|purchase order)\b"), ("Cybersecurity", r"\b(cyber(security|attack)?|breach|hack(ed|ers)?|ransomware|data leak)\b"),
    ("Management", r"\b(ceo|cfo|coo|chief executive|resign(s|ed|ation)?|appoint(s|ed|ment)?|steps down|board of directors)\b"),
    ("Partnerships", r"\b(partner(s|ship)?|collaborat(e|es|ion)|teams up|alliance|joint venture|agreement with|signs (agreement|deal))\b"), ("Customers", r"\b(customer|selects|deploys|adopts|chosen by)\b"),
    ("Products", r"\b(launch(es|ed)?|unveil(s|ed)?|introduc(es|ed)|new (chip|product|model|service|system|processor|platform)|announces? new)\b"),
    ("Analyst Activity", r"\b(upgrade[sd]?|downgrade[sd]?|price target|analysts?|overweight|underweight|outperform|initiat(es|ed) coverage)\b"),
    ("Operations", r"\b(layoffs?|job cuts|restructuring|plant|factory|facility|production|supply chain|recall|capacity|offering|raises \$)\b"), ("Competition", r"\b(rival|competitor|competition|versus|vs\.|market share)\b"),
    ("Macroeconomic", r"\b(fed|interest rates?|inflation|recession|jobs report|treasury yields?|cpi|gdp)\b"), ("Industry", r"\b(industry|sector|chipmakers|quantum stocks|semiconductor stocks|peers)\b"),
]
SUMMARY_SKIPS = ["Government & Policy", "Industry", "Competition", "Earnings"]
CATEGORY_WEIGHT = {
    "Earnings": 3, "M&A": 3, "Legal": 2, "Regulatory": 2, "Government & Policy": 2, "Contracts": 2, "Cybersecurity": 2, "Management": 2, "Partnerships": 2, "Customers": 1.5, "Products": 1.5, "Operations": 1.5,
    "Analyst Activity": 1, "Competition": 0.5, "Industry": 0, "Macroeconomic": 0, "Other": 0, "Ownership filings": -4,
}
GOV_KINDS = [
    ("Court ruling", r"\b(court rules?|ruled|judge (rules|blocks|orders)|ruling|verdict|appeals court|supreme court)\b"), ("Legislation passed", r"\b(passes|passed|signs into law|signed into law|enacted)\b"),
    ("Investigation", r"\b(probe|investigat(es|ion|ing)|subpoena|inquiry)\b"),
    ("Agency action", r"\b(fined|fines|imposes|imposed|blocks|blocked|approves|approved|awards|awarded|ordered|charged|sues|sued|bans|banned|revokes)\b"),
    ("Award or contract", r"\b(wins|won|secures|secured|finaliz(es|ed)|receives|received)\b.*\b(award|funding|grant|contract|incentive)s?\b"),
    ("Implemented policy", r"\b(takes effect|went into effect|now in effect|begins? enforcing|implemented)\b"),
    ("Proposal", r"\b(propos(e|es|ed|al)|consider(s|ing)?|weigh(s|ing)?|plans?|planning|threaten(s|ed)?|bill would|draft|could|may)\b"), ("Statement", r"\b(says|said|warns|calls for|urges|comments?|criticiz(es|ed)|praises)\b"),
]
MAJOR_OUTLETS = ["reuters.com", "apnews.com", "bloomberg.com", "wsj.com", "ft.com", "cnbc.com", "nytimes.com", "barrons.com", "marketwatch.com", "economist.com", "washingtonpost.com", "theinformation.com", "axios.com", "fortune.com",
                 "forbes.com", "businessinsider.com", "theverge.com", "techcrunch.com"]
SOURCE_RANK = {"primary_company": 0, "company": 0, "primary_regulatory": 1, "primary_government": 1, "reporting": 2, "aggregator": 3}
STOP = ("a an the of to in on for and or with by at as is are be its it from after over says say said new this that stock stocks shares share inc corp co ltd will has have just what why how here").split()
WIRES = ["prnewswire.com", "businesswire.com", "globenewswire.com", "accesswire.com", "newsfilecorp.com"]
REPORTING = ["reuters.com", "apnews.com", "bloomberg.com", "wsj.com", "ft.com", "cnbc.com", "barrons.com", "nytimes.com", "marketwatch.com", "investors.com", "washingtonpost.com", "economist.com", "fortune.com", "forbes.com",
             "finance.yahoo.com", "morningstar.com", "axios.com", "theinformation.com", "bbc.com", "cnn.com"]
INDUSTRY = ["thequantuminsider.com", "quantumcomputingreport.com", "semiconductor-digest.com", "semianalysis.com", "fiercebiotech.com", "fiercepharma.com", "statnews.com", "techcrunch.com", "theverge.com", "arstechnica.com",
            "datacenterdynamics.com", "tomshardware.com", "eetimes.com", "spglobal.com", "zdnet.com", "wired.com"]
SOCIAL = ["reddit.com", "x.com", "twitter.com", "stocktwits.com", "facebook.com", "youtube.com", "tiktok.com", "threads.net", "medium.com", "substack.com", "quora.com", "discord.com", "telegram.org", "t.me", "linkedin.com"]
ABBREVIATIONS = ["Inc.", "Corp.", "Co.", "Ltd.", "U.S.", "No.", "St.", "Jr.", "Sr.", "N.V.", "S.A.", "L.P.", "plc.", "e.g.", "i.e.", "approx.", "vs.", "Ph.D."]
