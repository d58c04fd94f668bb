"""Site audit: whole fingerprint record, metric pillars, signals and the outcome of crawls and audits.

A page table holds ``domain``, ``url``, ``path``, ``html``, ``headers`` (map), ``http_status``, ``ttfb_ms`` and
``duration_ms``; the home page of a domain has the path ``/``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospectra.functions.extract import growth_samples
from prospectra.functions.text import contains_any, visible_text

# fixed values: hosts of booking widgets, kinds of local businesses, old image formats
BOOKING_HOSTS = ["calendly.com", "acuityscheduling.com", "zocdoc.com", "jane.app", "mindbodyonline.com", "setmore.com", "squareup.com/appointments", "appointlet.com", "timely.com", "vagaro.com"]
LOCAL_KINDS = ["localbusiness", "dentist", "physician", "legalservice", "roofingcontractor", "hvacbusiness", "medicalbusiness", "restaurant", "store"]
LEGACY_IMAGES = r"\.(png|jpg|jpeg|gif|bmp|tiff)$"
# fixed values: marks of site builders, in order of precedence
BUILDERS = {
    "Webflow": ["data-wf-page", "data-wf-site", "webflow.com", "webflow.js"],
    "Shopify": ["cdn.shopify.com", "shopify.theme", "myshopify.com"],
    "Squarespace": ["static1.squarespace.com", "squarespace-headers"],
    "Wix": ["wix.com", "_wix_", "wixsite.com"],
}


def _attr(tag: Column, name: str) -> Column:
    """Value of an attribute of a tag, in double, single or no quotes; null if the tag lacks it."""
    pick = lambda quoted: F.regexp_extract(tag, rf"(?i)\s{name}\s*=\s*{quoted}", 1)
    value = F.coalesce(F.nullif(pick('"([^"]*)"'), F.lit("")), F.nullif(pick("'([^']*)'"), F.lit("")), F.nullif(pick(r"([^\s\"'>]+)"), F.lit("")))
    return F.when(tag.rlike(rf"(?i)\s{name}\s*="), F.coalesce(value, F.lit("")))


def _tags(html: Column, name: str) -> Column:
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(rf"(?i)(<{name}(?:\s[^>]*)?>)"), F.lit(1))


def _header(headers: Column, name: str) -> Column:
    """Value of a header, whatever the case of its name; '' if it lacks."""
    return F.coalesce(F.get(F.map_values(F.map_filter(headers, lambda k, _: F.lower(k) == name)), F.lit(0)), F.lit(""))


def fingerprint_backend(headers: Column) -> Column:
    """Sorted back-end stack by headers and cookies."""
    powered, server, cookie = F.lower(_header(headers, "x-powered-by")), F.lower(_header(headers, "server")), _header(headers, "set-cookie")
    laravel = F.contains(cookie, F.lit("laravel_session")) | F.contains(powered, F.lit("laravel"))
    found = [(F.contains(powered, F.lit("php")) | laravel, "PHP"), (laravel, "Laravel"), (F.contains(powered, F.lit("asp.net")) | F.contains(server, F.lit("iis")), "ASP.NET"), (F.contains(powered, F.lit("express")), "Node.js/Express")]
    return F.array_sort(F.array_compact(F.array(*(F.when(cond, F.lit(name)) for cond, name in found))))


def fingerprint_libraries(html: Column) -> dict[str, Column]:
    """Structs (version, src) of jquery, angularjs, bootstrap, vue and react by the first script that names them, null for none; ``angular`` is the version of a modern one."""
    srcs = F.filter(F.transform(_tags(html, "script"), lambda t: _attr(t, "src")), lambda s: s.isNotNull() & (s != ""))
    sheets = F.filter(F.transform(F.filter(_tags(html, "link"), lambda t: F.contains(F.lower(t), F.lit("stylesheet"))), lambda t: _attr(t, "href")), lambda s: s.isNotNull())
    low = F.lower(F.coalesce(html, F.lit("")))

    def named(name: str, sources: Column) -> Column:
        src = F.get(F.filter(sources, lambda s: F.contains(F.lower(s), F.lit(name))), F.lit(0))
        version = F.nullif(F.regexp_extract(F.lower(src), rf"{name}(?:\.min|js|\.js)?[-./@v]*([0-9]+\.[0-9]+(?:\.[0-9]+)?)", 1), F.lit(""))
        return F.when(src.isNotNull(), F.struct(version.alias("version"), src.alias("src")))

    mark = lambda cond, what: F.when(cond, F.struct(F.lit(None).cast("string").alias("version"), F.lit(what).alias("src")))
    angular = F.when(low.rlike(r"\sng-version\s*="), F.regexp_extract(low, r"\sng-version\s*=\s*[\"']?([0-9.]*)", 1))
    return {
        "jquery": F.coalesce(named("jquery", srcs), mark(F.coalesce(html, F.lit("")).rlike(r"(?s)<script[^>]*>[^<]*jQuery"), "inline")),
        "angular": angular,
        "angularjs": F.when(angular.isNull(), F.coalesce(named("angular", srcs), mark(low.rlike(r"\sng-(app|controller)[\s=>]"), "ng-app"))),
        "bootstrap": F.coalesce(named("bootstrap", srcs), named("bootstrap", sheets)),
        "vue": F.coalesce(named("vue", srcs), mark(contains_any(low, ["data-v-", "__vue__"]), "data-v")),
        "react": F.coalesce(named("react", srcs), mark(contains_any(low, ["data-reactroot", "_reactlistening"]), "data-reactroot")),
    }


def site_fingerprint(pages: DataFrame) -> DataFrame:
    """Fingerprint record of each page: ``cms``, ``wp_version``, ``frontend`` and ``backend`` stacks (sorted, distinct), library structs, ``is_spa``, ``https``, ``hsts``."""
    html, low = F.coalesce("html", F.lit("")), F.lower(F.coalesce("html", F.lit("")))
    generator = F.get(F.filter(_tags(html, "meta"), lambda t: F.lower(_attr(t, "name")) == "generator"), F.lit(0))
    content = _attr(generator, "content")
    wp = F.nullif(F.regexp_extract(content, r"(?i)wordpress\s*([0-9]+(?:\.[0-9]+)*)", 1), F.lit(""))
    paths = F.exists(F.concat(_tags(html, "script"), _tags(html, "link"), _tags(html, "img")), lambda t: contains_any(t, ["wp-content", "wp-includes"]))
    wordpress = wp.isNotNull() | paths
    builder = {name: contains_any(low, marks) for name, marks in BUILDERS.items()}
    cms = F.coalesce(F.when(wordpress, F.concat_ws(" ", F.lit("WordPress"), wp)), *(F.when(cond, F.lit(name)) for name, cond in builder.items()))
    libs = fingerprint_libraries(html)
    next_ = contains_any(low, ["/_next/", "__next_data__", "next-head-count"])
    nuxt = low.rlike(r"id\s*=\s*[\"']?__nuxt\b") | contains_any(low, ["/_nuxt/", "window.__nuxt__"])
    gatsby = contains_any(low, ["___gatsby", "gatsby-inlined-css"])
    svelte = low.rlike(r"class\s*=\s*[\"'][^\"']*svelte-") | F.contains(low, F.lit("__sveltekit"))
    root = F.regexp_extract(html, r"(?is)<[a-z]+[^>]*\sid\s*=\s*[\"']?(?:root|app|__next)[\"'\s>][^>]*>?(.{0,400})", 0)
    spa = (root != "") & (F.length(F.trim(F.regexp_replace(F.regexp_extract(root, r"(?s)>(.*?)</", 1), "<[^>]*>", ""))) < 20) & low.rlike(r"<script[^>]*\ssrc")
    version = lambda name, shown, cond=F.lit(True): F.when(F.col(name).isNotNull() & cond, F.concat_ws(" ", F.lit(shown), F.col(f"{name}.version")))
    flag = lambda cond, name: F.when(cond, F.lit(name))
    rows = pages.withColumns({**libs, "wp_version": wp, "cms": cms, "next_": next_, "nuxt": nuxt, "gatsby": gatsby})
    plain_vue = F.when(F.col("vue.version").isNull(), F.lit("Vue.js")).otherwise(F.concat(F.lit("Vue "), F.col("vue.version")))
    frontend = [
        *(flag(builder[b], b) for b in BUILDERS), flag(F.col("next_"), "Next.js"), flag(F.col("next_") | F.col("gatsby"), "React"), flag(F.col("nuxt"), "Nuxt.js"), flag(F.col("nuxt"), "Vue.js"),
        flag(F.col("gatsby"), "Gatsby"), flag(svelte, "Svelte"), version("jquery", "jQuery"), F.when(F.col("angular").isNotNull(), F.trim(F.concat(F.lit("Angular "), F.col("angular")))),
        version("angularjs", "AngularJS"), version("bootstrap", "Bootstrap"), F.when(F.col("vue").isNotNull() & ~F.col("nuxt"), plain_vue), version("react", "React", ~F.col("next_") & ~F.col("gatsby")),
    ]
    backend = F.concat(fingerprint_backend(F.col("headers")), F.array_compact(F.array(flag(wordpress, "PHP"), flag(wordpress, "WordPress"), flag(builder["Shopify"], "Shopify"))))
    return rows.withColumns({
        "frontend": F.array_sort(F.array_distinct(F.array_compact(F.array(*frontend)))), "backend": F.array_sort(F.array_distinct(backend)), "is_spa": spa,
        "https": F.lower("url").startswith("https://"), "hsts": F.array_contains(F.transform(F.map_keys("headers"), F.lower), "strict-transport-security"),
    }).drop("next_", "nuxt", "gatsby")


def company_signals(pages: DataFrame) -> DataFrame:
    """Growth signals of each page: ``type``, ``subtype``, ``sample`` and ``confidence``."""
    found = growth_samples(visible_text(F.col("html")))
    rows = F.array_compact(F.array(*(F.when(s.isNotNull(), F.struct(F.lit(f"company_signal_{k}").alias("type"), F.lit(k).alias("subtype"), s.alias("sample"))) for k, s in found.items())))
    return pages.select("domain", "url", F.explode(rows).alias("s")).select("domain", "url", "s.*", F.lit(0.80).alias("confidence"))


def speed_metrics(pages: DataFrame) -> DataFrame:
    """Per domain: speed of the home page, the slowest page, whether it lags far behind, slow answers, scripts, images and compression."""
    home, encoding = F.col("path") == "/", F.lower(_header(F.col("headers"), "content-encoding"))
    duration = F.coalesce("duration_ms", F.lit(0))
    blocking = F.size(F.filter(_tags(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<head[^>]*>(.*?)</head>", 1), "script"), lambda t: t.rlike(r"(?i)\ssrc") & ~t.rlike(r"(?i)\s(async|defer)")))
    out = pages.groupBy("domain").agg(
        F.max(F.when(home, duration)).alias("homepage_ms"),
        F.max(F.when(home, F.col("ttfb_ms"))).alias("ttfb_ms"),
        F.max_by("path", F.struct(duration, home, F.col("path"))).alias("slowest_path"),
        F.max(duration).alias("slowest_ms"),
        F.bool_or(F.coalesce("ttfb_ms", F.lit(0)) > 1200).alias("slow_backend"),
        F.sum(blocking).alias("blocking_scripts"),
        F.sum(F.size(_tags(F.col("html"), "img"))).alias("n_images"),
        F.bool_or(home & encoding.rlike("gzip|br")).alias("compressed"),
    )
    return out.withColumn("speed_discrepancy", (F.col("slowest_ms") - F.col("homepage_ms") > 1500) & (F.col("slowest_ms") > 3000))


def conversion_metrics(pages: DataFrame) -> DataFrame:
    """Per domain: phone number seen and clickable, longest form, autocomplete, booking widgets, a call button that stays."""
    forms = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"(?is)<form[^>]*>(.*?)</form>"), F.lit(1))
    fields = lambda f: F.filter(F.regexp_extract_all(f, F.lit(r"(?i)(<(?:input|textarea|select)(?:\s[^>]*)?>)"), F.lit(1)), lambda t: ~t.rlike(r"(?i)\stype\s*=\s*[\"']?hidden"))
    frames = F.transform(_tags(F.col("html"), "iframe"), lambda t: F.lower(F.coalesce(_attr(t, "src"), F.lit(""))))
    widgets = F.filter(F.array(*map(F.lit, BOOKING_HOSTS)), lambda host: F.exists(frames, lambda s: F.contains(s, host)))
    phone = visible_text(F.col("html")).rlike(r"\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}")
    sticky = F.lower("html").rlike(r"class\s*=\s*[\"'][^\"']*(sticky-cta|floating-btn|mobile-call-bar|sticky-call|floating-call)")
    out = pages.groupBy("domain").agg(
        F.bool_or(phone).alias("visible_phone"),
        F.bool_or(F.exists(_tags(F.col("html"), "a"), lambda t: F.coalesce(_attr(t, "href"), F.lit("")).startswith("tel:"))).alias("tel_link"),
        F.coalesce(F.max(F.array_max(F.transform(forms, lambda f: F.size(fields(f))))), F.lit(0)).alias("max_form_inputs"),
        F.bool_or(F.exists(forms, lambda f: F.exists(fields(f), lambda t: t.rlike(r"(?i)\sautocomplete\s*=")))).alias("autocomplete"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(widgets)))).alias("booking_widgets"),
        F.bool_or(sticky).alias("sticky_cta"),
    )
    return out.withColumn("missing_tel_link", F.col("visible_phone") & ~F.col("tel_link")).withColumn("high_form_friction", F.col("max_form_inputs") >= 7)


def seo_metrics(homes: DataFrame) -> DataFrame:
    """Structured data, sharing cards, headings and description of home pages."""
    metas = _tags(F.col("html"), "meta")
    has = lambda names: F.exists(metas, lambda t: F.coalesce(_attr(t, "property"), _attr(t, "name")).isin(names) & (F.coalesce(_attr(t, "content"), F.lit("")) != ""))
    data = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    return homes.select(
        "domain", (F.size(data) > 0).alias("has_json_ld"), F.exists(data, lambda x: contains_any(F.lower(x), LOCAL_KINDS)).alias("has_local_business"), has(["og:image"]).alias("has_og_image"),
        (~(has(["og:image"]) & has(["og:title"]))).alias("broken_social"), F.size(_tags(F.col("html"), "h1")).alias("h1_count"), has(["description"]).alias("has_description"),
    )


def security_metrics(homes: DataFrame) -> DataFrame:
    """Transport, protective headers and mixed content of home pages."""
    names = F.transform(F.map_keys("headers"), F.lower)
    https = F.col("url").startswith("https://")
    header = lambda n: F.coalesce(F.array_contains(names, n), F.lit(False))
    return homes.select("domain", https.alias("https"), header("strict-transport-security").alias("hsts"), header("content-security-policy").alias("csp"), header("x-frame-options").alias("x_frame"), (https & F.coalesce("html", F.lit("")).rlike("src=[\"']http://")).alias("mixed_content"))


def image_metrics(pages: DataFrame) -> DataFrame:
    """Per domain: images, those not lazy beyond the first two, without alternative text, in old formats, and whether that calls for work."""
    images = _tags(F.col("html"), "img")
    count = lambda test: F.sum(F.size(F.filter(images, test)))
    source = lambda t: F.regexp_replace(F.lower(F.coalesce(_attr(t, "src"), _attr(t, "data-src"), F.lit(""))), r"\?.*$", "")
    out = pages.groupBy("domain").agg(
        F.sum(F.size(images)).alias("n_images"),
        count(lambda t: F.lower(F.coalesce(_attr(t, "loading"), F.lit(""))) != "lazy").alias("not_lazy"),
        count(lambda t: F.trim(F.coalesce(_attr(t, "alt"), F.lit(""))) == "").alias("without_alt"),
        count(lambda t: source(t).rlike(LEGACY_IMAGES)).alias("legacy_format"),
    )
    out = out.withColumn("not_lazy", F.when(F.col("n_images") > 2, F.greatest(F.lit(0), F.col("not_lazy") - 2)).otherwise(0))
    return out.withColumn("image_issues", (F.col("not_lazy") > 2) | (F.col("legacy_format") > 3) | (F.col("without_alt") > 3))


def assemble_audit(pages: DataFrame, certificates: DataFrame | None = None, mail: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
    """One row of audit metrics per domain, null where the home page can't be reached.

    The optional tables hold ``domain`` and columns of certificates, mail records and link health.
    """
    homes = pages.where(F.col("path") == "/").dropDuplicates(["domain"])
    up = (F.coalesce("http_status", F.lit(0)).between(1, 399)) & (F.coalesce("html", F.lit("")) != "")
    state = homes.select("domain", "url", "http_status", up.alias("reachable"))
    reached = pages.join(state.where("reachable").select("domain"), "domain", "left_semi")
    parts = [speed_metrics(reached), conversion_metrics(reached), seo_metrics(homes), security_metrics(homes), image_metrics(reached).drop("n_images"), *(t for t in (certificates, mail, links) if t is not None)]
    for part in parts:
        state = state.join(part, "domain", "left")
    metrics = [c for c in state.columns if c not in ("domain", "url", "http_status", "reachable")]
    return state.select("domain", "url", "http_status", "reachable", *(F.when(F.col("reachable"), F.col(c)).alias(c) for c in metrics))


def crawl_outcome(crawls: DataFrame) -> dict[str, DataFrame]:
    """Rows that a crawl leaves: ``signals``, ``audits``, ``technologies`` and ``scores`` of failed ones, ``pages`` and ``technologies`` of the others."""
    status = F.coalesce("http_status", F.lit(0))
    failed = (F.coalesce("html", F.lit("")) == "") | (status == 0) | (status >= 400)
    bad, good = crawls.where(failed), crawls.where(~failed)
    none = F.array().cast("array<string>")
    marks = bad.select("company_id", F.lit(None).cast("string").alias("cms"), none.alias("frontend"), none.alias("backend"), F.lit(False).alias("https"), F.lit(False).alias("hsts"), F.lit(True).alias("crawl_failed"))
    prints = site_fingerprint(good).select("company_id", "cms", "frontend", "backend", "https", "hsts", F.lit(False).alias("crawl_failed"))
    return {
        "signals": bad.select("company_id", F.lit("crawl_audit_failed").alias("type"), "url", F.lit(100.0).alias("confidence"), status.alias("http_status")),
        "audits": bad.select("company_id", "url", F.lit(0).alias("performance_score"), F.lit("failed").alias("status")),
        "technologies": marks.unionByName(prints),
        "scores": bad.select("company_id", F.lit(0.0).alias("company_fit"), F.lit(0.0).alias("opportunity_score"), F.lit("disqualified").alias("priority_tier")),
        "pages": good.select("company_id", "url", "http_status", "headers"),
    }


def audit_outcome(companies: DataFrame, audits: DataFrame, pains: DataFrame, disqualified: Column) -> DataFrame:
    """Outcome of each company's audit with its tier and signal: ``disqualified``, ``failed``, ``clean`` or ``success``, by the first that holds."""
    found = pains.groupBy("company_id").agg(F.count("*").alias("n_pains"))
    rows = companies.withColumn("out", F.coalesce(disqualified, F.lit(False))).join(audits.select("company_id", "reachable"), "company_id", "left").join(found, "company_id", "left")
    outcome = F.when(F.col("out"), "disqualified").when(~F.coalesce("reachable", F.lit(False)), "failed").when(F.coalesce("n_pains", F.lit(0)) == 0, "clean").otherwise("success")
    rows = rows.withColumn("outcome", outcome)
    o = F.col("outcome")
    return rows.select(
        "company_id", "outcome", F.when(o.isin("disqualified", "failed"), "disqualified").alias("priority_tier"), F.when(o.isin("disqualified", "failed"), 0.0).alias("opportunity_score"),
        F.when(o == "failed", "crawl_audit_failed").when(o == "clean", "clean_audit_verified").alias("signal"), F.when(o == "failed", 100.0).when(o == "clean", 95.0).alias("confidence"),
    )
