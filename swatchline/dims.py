"""Word lists, colour tables and patterns that results depend on, in their natural order."""

NAMED_COLORS = {
    "aliceblue": "#f0f8ff", "antiquewhite": "#faebd7", "aqua": "#00ffff", "aquamarine": "#7fffd4", "azure": "#f0ffff",
    "beige": "#f5f5dc", "bisque": "#ffe4c4", "black": "#000000", "blanchedalmond": "#ffebcd", "blue": "#0000ff",
    "blueviolet": "#8a2be2", "brown": "#a52a2a", "burlywood": "#deb887", "cadetblue": "#5f9ea0",
    "chartreuse": "#7fff00", "chocolate": "#d2691e", "coral": "#ff7f50", "cornflowerblue": "#6495ed",
    "cornsilk": "#fff8dc", "crimson": "#dc143c", "cyan": "#00ffff", "darkblue": "#00008b", "darkcyan": "#008b8b",
    "darkgoldenrod": "#b8860b", "darkgray": "#a9a9a9", "darkgreen": "#006400", "darkgrey": "#a9a9a9",
    "darkkhaki": "#bdb76b", "darkmagenta": "#8b008b", "darkolivegreen": "#556b2f", "darkorange": "#ff8c00",
    "darkorchid": "#9932cc", "darkred": "#8b0000", "darksalmon": "#e9967a", "darkseagreen": "#8fbc8f",
    "darkslateblue": "#483d8b", "darkslategray": "#2f4f4f", "darkslategrey": "#2f4f4f", "darkturquoise": "#00ced1",
    "darkviolet": "#9400d3", "deeppink": "#ff1493", "deepskyblue": "#00bfff", "dimgray": "#696969",
    "dimgrey": "#696969", "dodgerblue": "#1e90ff", "firebrick": "#b22222", "floralwhite": "#fffaf0",
    "forestgreen": "#228b22", "fuchsia": "#ff00ff", "gainsboro": "#dcdcdc", "ghostwhite": "#f8f8ff",
    "gold": "#ffd700", "goldenrod": "#daa520", "gray": "#808080", "green": "#008000", "greenyellow": "#adff2f",
    "grey": "#808080", "honeydew": "#f0fff0", "hotpink": "#ff69b4", "indianred": "#cd5c5c", "indigo": "#4b0082",
    "ivory": "#fffff0", "khaki": "#f0e68c", "lavender": "#e6e6fa", "lavenderblush": "#fff0f5", "lawngreen": "#7cfc00",
    "lemonchiffon": "#fffacd", "lightblue": "#add8e6", "lightcoral": "#f08080", "lightcyan": "#e0ffff",
    "lightgoldenrodyellow": "#fafad2", "lightgray": "#d3d3d3", "lightgreen": "#90ee90", "lightgrey": "#d3d3d3",
    "lightpink": "#ffb6c1", "lightsalmon": "#ffa07a", "lightseagreen": "#20b2aa", "lightskyblue": "#87cefa",
    "lightslategray": "#778899", "lightslategrey": "#778899", "lightsteelblue": "#b0c4de", "lightyellow": "#ffffe0",
    "lime": "#00ff00", "limegreen": "#32cd32", "linen": "#faf0e6", "magenta": "#ff00ff", "maroon": "#800000",
    "mediumaquamarine": "#66cdaa", "mediumblue": "#0000cd", "mediumorchid": "#ba55d3", "mediumpurple": "#9370db",
    "mediumseagreen": "#3cb371", "mediumslateblue": "#7b68ee", "mediumspringgreen": "#00fa9a",
    "mediumturquoise": "#48d1cc", "mediumvioletred": "#c71585", "midnightblue": "#191970", "mintcream": "#f5fffa",
    "mistyrose": "#ffe4e1", "moccasin": "#ffe4b5", "navajowhite": "#ffdead", "navy": "#000080", "oldlace": "#fdf5e6",
    "olive": "#808000", "olivedrab": "#6b8e23", "orange": "#ffa500", "orangered": "#ff4500", "orchid": "#da70d6",
    "palegoldenrod": "#eee8aa", "palegreen": "#98fb98", "paleturquoise": "#afeeee", "palevioletred": "#db7093",
    "papayawhip": "#ffefd5", "peachpuff": "#ffdab9", "peru": "#cd853f", "pink": "#ffc0cb", "plum": "#dda0dd",
    "powderblue": "#b0e0e6", "purple": "#800080", "rebeccapurple": "#663399", "red": "#ff0000",
    "rosybrown": "#bc8f8f", "royalblue": "#4169e1", "saddlebrown": "#8b4513", "salmon": "#fa8072",
    "sandybrown": "#f4a460", "seagreen": "#2e8b57", "seashell": "#fff5ee", "sienna": "#a0522d", "silver": "#c0c0c0",
    "skyblue": "#87ceeb", "slateblue": "#6a5acd", "slategray": "#708090", "slategrey": "#708090", "snow": "#fffafa",
    "springgreen": "#00ff7f", "steelblue": "#4682b4", "tan": "#d2b48c", "teal": "#008080", "thistle": "#d8bfd8",
    "tomato": "#ff6347", "turquoise": "#40e0d0", "violet": "#ee82ee", "wheat": "#f5deb3", "white": "#ffffff",
    "whitesmoke": "#f5f5f5", "yellow": "#ffff00", "yellowgreen": "#9acd32",
}
EXTENSIONS = ["html", "htm", "css", "scss", "sass", "less", "styl", "jsx", "tsx", "js", "ts", "vue", "svelte", "astro"]
CSS_PROPERTIES = [
    "color", "background-color", "background", "border-color", "border-top-color", "border-right-color", "border-bottom-color", "border-left-color",
    "border", "outline-color", "outline", "text-decoration-color", "fill", "stroke", "stop-color", "flood-color", "lighting-color",
    "column-rule-color", "caret-color", "accent-color", "box-shadow", "text-shadow", "scrollbar-color",
]
JS_PROPERTIES = [
    "color", "backgroundColor", "background", "borderColor", "borderTopColor", "borderRightColor", "borderBottomColor", "borderLeftColor",
    "border", "outlineColor", "outline", "textDecorationColor", "fill", "stroke", "boxShadow", "textShadow", "caretColor", "accentColor", "columnRuleColor",
]
TW_PREFIXES = ["bg", "text", "border", "ring", "shadow", "divide", "outline", "accent", "fill", "stroke", "decoration", "placeholder", "from", "via", "to", "caret"]
TW_NAMES = [
    "slate", "gray", "zinc", "neutral", "stone", "red", "orange", "amber", "yellow", "lime", "green", "emerald", "teal", "cyan", "sky", "blue",
    "indigo", "violet", "purple", "fuchsia", "pink", "rose",
]
TW_SPECIALS = ["black", "white", "transparent", "current", "inherit"]
TW_SHADES = ["50", "100", "200", "300", "400", "500", "600", "700", "800", "900", "950"]
TW_ENTRY_FILES = ["tailwind.css", "globals.css", "app.css", "global.css", "index.css"]
CANVAS_IMPORTS = [
    "three", "@react-three", "react-force-graph", "sigma", "@sigma", "graphology", "pixi", "pixijs", "@pixi", "d3", "canvas", "fabric", "konva",
    "react-konva", "paper", "p5", "chart.js", "recharts", "visx", "nivo", "sharp", "jimp", "node-canvas",
]
COLOR_SPACES = ["srgb", "srgb-linear", "display-p3", "a98-rgb", "prophoto-rgb", "rec2020", "xyz", "xyz-d50", "xyz-d65"]
FUNCTIONS = ["oklch", "oklab", "lch", "lab", "hwb"]
SCRIPT_EXTENSIONS = ["js", "jsx", "ts", "tsx", "mjs", "cjs"]
STYLE_EXTENSIONS = ["css", "scss", "sass", "less"]
IMPORT_LINES = 100
DEFINITION_FILES = [
    r"\.theme\.[jt]sx?$", r"[/\\]theme\.[jt]sx?$", r"[/\\]themes?[/\\].*\.[jt]sx?$", r"[/\\]tokens?\.[jt]sx?$",
    r"[/\\]palette\.[jt]sx?$", r"[/\\]colors?\.[jt]sx?$", r"design-tokens", r"tailwind\.config",
]
MAPPING_FILES = [r"[Ee]ngine\.[jt]sx?$", r"[Mm]apper\.[jt]sx?$", r"[Cc]onverter\.[jt]sx?$", r"[Mm]apping\.[jt]sx?$", r"MCP[Ss]ervice\.[jt]sx?$"]
THEME_BUILDERS = [r"createTheme\s*\(", r"createMuiTheme\s*\(", r"extendTheme\s*\("]
CONTEXT_LABELS = {
    "actionable": "ACTIONABLE", "css-definition": "CSS VAR DEFINITION", "theme-definition": "THEME DEFINITION", "canvas": "CANVAS/WEBGL",
    "mapping": "MAPPING/LOOKUP", "generated": "GENERATED CODE", "meta": "META/MANIFEST", "effect": "EFFECT (black/white alpha)",
}
PROPERTY_CATEGORIES = {
    "background": ["background", "backgroundColor", "bg"],
    "text": ["color", "textDecorationColor", "caretColor"],
    "border": ["borderColor", "borderTopColor", "borderRightColor", "borderBottomColor", "borderLeftColor", "border-color", "border-top-color", "border-right-color", "border-bottom-color", "border-left-color", "outlineColor", "outline-color"],
    "shadow": ["boxShadow", "textShadow", "box-shadow", "text-shadow"],
    "fill": ["fill", "stroke"],
}
CATEGORY_NAMES = {"background": "bg|background", "text": "text|font|foreground", "border": "border|outline|ring|divide", "shadow": "shadow", "fill": "fill|stroke"}
EXCLUDED = r"(^|/)(node_modules|\.git|dist|build|coverage|\.next)/|\.min\.(js|css)$|\.map$|(^|/)(package-lock\.json|yarn\.lock|pnpm-lock\.yaml|bun\.lockb)$"

# White space as the trimmed and split strings know it
SPACE = r"[\t\n\x0B\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
TRIM = f"^{SPACE}+|{SPACE}+$"
# Patterns of literals
COLOR = "(?i)" + "|".join([r"#(?:[0-9a-fA-F]{3,4}){1,2}\b", r"\brgba?\([^)]+\)", r"\bhsla?\([^)]+\)", *(rf"\b{f}\([^)]+\)" for f in FUNCTIONS), r"\bcolor\(\s*(?:" + "|".join(COLOR_SPACES) + r")\b[^)]*\)"])
COLOR_GATE, NAMED_CSS_GATE, NAMED_JS_GATE = r"[#(]", r":\s*[a-zA-Z]", r""":\s*['"][a-zA-Z]"""  # what a line with a match holds
NAMED_CSS = "(?:" + "|".join(CSS_PROPERTIES) + r")\s*:\s*(?:[a-zA-Z]+)"
NAMED_JS = "(?:" + "|".join(JS_PROPERTIES) + r""")\s*:\s*['"](?:[a-zA-Z]+)['"]"""
NAMED_WORD = r""":\s*['"]?([a-zA-Z]+)['"]?\s*[;,}]?\s*$"""
TAILWIND = rf"(?i)\b(?:{'|'.join(TW_PREFIXES)})-(?:{'|'.join(TW_NAMES)})-(?:{'|'.join(TW_SHADES)})(?:/\d+)?\b|\b(?:{'|'.join(TW_PREFIXES)})-(?:{'|'.join(TW_SPECIALS)})(?:/\d+)?\b|\b(?:{'|'.join(TW_PREFIXES)})-\[[^\]]*\]"
TW_ARBITRARY, TW_STANDARD, TW_SPECIAL = r"^(\w+)-\[([^\]]+)\]$", r"^(\w+)-(\w+)-(\d+)(?:/(\d+))?$", r"^(\w+)-(\w+)(?:/(\d+))?$"
CLASS_ATTRIBUTES = [r'className="[^"]*"', r"className='[^']*'", r'class="[^"]*"', r"class='[^']*'"]
CLASS_VALUE = r"""(?:className|class)=["']([^"']*)["']"""
CLASS_FUNCTIONS = [r"""(?:cn|clsx|twMerge|cva)\(\s*["'](?:[^"']*)["']""", r"""(?:cn|clsx|twMerge|cva)\([^)]*["'](?:[^"']+)["']"""]
CLASS_ARGUMENT = r"""["']([^"']+)["']"""
CSS_PROPERTY = r"(?i)\b([\w-]+)\s*:\s*(?:#|rgb|hsl|oklch|oklab|lch|lab|hwb|color\()"
JS_PROPERTY = r"""\b(\w+)\s*:\s*['"]"""
COMMENT_LINE, COMMENT_LINE_JSX = r"^\s*(?://|\*|/\*)", r"^\s*(?://|\*|\{/\*)"
TYPE_ANNOTATION = r":\s*(?:string|number|boolean|void|any)\b"
THEME_BLOCK, THEME_VAR, UTILITY, THEME_OPEN = r"@theme\s*\{([^}]+)\}", r"--([\w-]+)\s*:\s*([^;]+)", r"@utility\s+[\w-]+", r"@theme\s*\{"
PALETTE_CSS = r"--([\w-]+)\s*:\s*(#[0-9a-fA-F]{3,8}|rgba?\([^)]+\)|hsla?\([^)]+\)|[a-zA-Z]+)\s*;?"
PALETTE_JS = r"""['"]?([\w-]+)['"]?\s*:\s*['"]([^'"]+)['"]"""
# Forms of colour functions; groups are the components
RGB_MODERN = r"rgba?\(\s*([\d.]+)%?\s+([\d.]+)%?\s+([\d.]+)%?\s*(?:/\s*[\d.]+%?\s*)?\)"
RGB_LEGACY = r"rgba?\(\s*([\d.]+)%?\s*,\s*([\d.]+)%?\s*,\s*([\d.]+)%?\s*(?:,\s*[\d.]+%?\s*)?\)"
RGB_PERCENT = r"rgba?\(\s*[\d.]+%"
HSL_MODERN = r"hsla?\(\s*([\d.]+)(?:deg|rad|grad|turn)?\s+([\d.]+)%?\s+([\d.]+)%?\s*(?:/\s*[\d.]+%?\s*)?\)"
HSL_LEGACY = r"hsla?\(\s*([\d.]+)(?:deg|rad|grad|turn)?\s*,\s*([\d.]+)%?\s*,\s*([\d.]+)%?\s*(?:,\s*[\d.]+%?\s*)?\)"
ALPHA_MODERN, ALPHA_LEGACY = r"/\s*([\d.]+)(%?)\s*\)", r",\s*([\d.]+)\s*\)"
# Rules of the line's context, in order
DEFINES = r"^\s*--[\w-]+\s*:"
OG_IMAGE = r"(?:from|require).*(?:satori|@vercel/og|ImageResponse)"
META_VALUE, META_TAG = r"""(?:content|color)\s*[:=]\s*["']#[0-9a-fA-F]""", r"(?:theme-color|msapplication|mask-icon|safari-pinned)"
TEMPLATE_OPEN, TEMPLATE_VALUE = r"`[\s\S]*<[\s\S]*>", r"\$\{"
KEY_CSS, KEY_SUFFIX, KEY_HEX, KEY_STRING = r"""^\s*['"][\w-]+\s*:.*#[0-9a-fA-F]""", r"""['"].*['"]""", r"""^\s*['"]#[0-9a-fA-F]{3,8}['"]""", r"""^\s*css\s*:\s*['"]"""
BRIDGE, FALLBACK = r"getCssVar|getComputedStyle|getPropertyValue", r"""\|\|\s*['"]#"""
EFFECTS = [r"^rgba?\(\s*0\s*,\s*0\s*,\s*0[\s,]", r"^rgba?\(\s*255\s*,\s*255\s*,\s*255[\s,]", r"^rgb\(\s*0\s+0\s+0\s*/", r"^rgb\(\s*255\s+255\s+255\s*/"]
EFFECT_HEX, EFFECT_LINE = r"(?i)^#(?:000(?:000)?|fff(?:fff)?)$", r"(?i)shadow|gradient|scan|glow|overlay"
