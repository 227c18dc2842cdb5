"""Rules that sort assets by names, and parsers of labelled text."""

from __future__ import annotations

import mimetypes
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, normalize_tr, words

#: Words that tell a kind of image: in a name (for renders anywhere, or only as a word), in a
#: folder, and at the end of a texture's name; source files that stand beside renders.
RENDER_WORDS = ["render", "rendering", "rendered", "rendre", "vray", "v-ray", "corona", "lumion", "enscape", "twinmotion", "archviz", "cgi", "visualisation", "visualization", "gorsellestirme", "görsellestirme", "gorsellestirilmis", "arnold", "octane", "redshift", "maxwell", "mentalray", "mental_ray", "cycles", "eevee", "iray", "fstorm", "thearender", "beauty", "masterbeauty", "crypto", "cryptomatte", "denoised"]
RENDER_WHOLE_WORDS = ["viz", "3d", "final", "output", "view", "scene", "sahne", "gorunum", "görünüm", "visual", "gorsel", "görsel", "exterior", "interior", "perspective", "perspektif", "cam", "camera"]
PHOTO_WORDS = ["foto", "fotograf", "fotoğraf", "photograph", "cek", "çek", "cekim", "çekim", "santiye", "şantiye", "mevcut", "existing", "as_built", "asbuilt", "screenshot", "ekran_goruntusu", "ekran_görüntüsü", "dcim", "photo_", "_photo", "photos", "canon", "nikon", "sony", "fujifilm", "leica", "panasonic", "olympus", "pentax", "lumix", "hasselblad", "iphone", "samsung", "galaxy", "xiaomi", "redmi", "huawei", "pixel", "oneplus", "oppo", "vivo", "dji", "mavic", "phantom", "inspire", "gopro", "whatsapp", "wechat", "telegram"]
TEXTURE_WORDS = ["doku", "texture", "material", "malzeme", "kaplama", "surface", "seamless", "tileable", "tile", "pattern", "desen", "map", "mapping", "pbr", "swatch"]
TEXTURE_ENDS = ["_diff", "_diffuse", "_albedo", "_basecolor", "_base_color", "_col", "_color", "_norm", "_normal", "_nrm", "_normalmap", "_bump", "_height", "_disp", "_displacement", "_spec", "_specular", "_gloss", "_glossiness", "_rough", "_roughness", "_rgh", "_metal", "_metallic", "_metalness", "_met", "_ao", "_ambient_occlusion", "_occlusion", "_cavity", "_opacity", "_alpha", "_mask", "_transparency", "_emissive", "_emission", "_self_illumination", "_refl", "_reflection", "_ior", "_env", "_hdri", "_cubemap", "_1k", "_2k", "_4k", "_8k", "_16k", "_512", "_1024", "_2048", "_4096"]
TEXTURE_FOLDERS = ["texture", "textures", "tex", "doku", "dokular", "material", "materials", "map", "maps", "mapping", "kaplama", "kaplamalar", "surface", "surfaces", "pbr", "tileable", "seamless", "06-dokular"]
RENDER_FOLDERS = ["render", "renders", "renderlar", "04-renderlar", "output", "outputs", "cikti", "final", "gorsel", "gorseller", "visual", "visuals", "vray", "v-ray", "corona", "lumion", "enscape", "archviz", "visualization"]
PHOTO_FOLDERS = ["foto", "fotograf", "fotograflar", "fotoğraf", "fotoğraflar", "photo", "photos", "photograph", "photographs", "santiye", "şantiye", "santiye_fotograflari", "mevcut_durum", "mevcut", "as_built", "asbuilt", "as-built", "dcim", "screenshot", "screenshots", "ekran_goruntusu", "ekran_görüntüsü", "site_photos", "site_photo", "survey", "field", "cekim", "çekim", "cekimler", "çekimler"]
RENDER_SIBLINGS = ["psd", "max", "3ds", "blend", "c4d", "skp", "rvt", "fbx", "obj", "exr", "hdr"]
RENDER_ENGINES = ["v-ray", "vray", "corona", "lumion", "enscape", "twinmotion", "arnold", "octane", "redshift", "maxwell", "mental ray", "mentalray", "cycles", "eevee", "iray", "fstorm", "3ds max", "3dsmax", "blender", "sketchup", "cinema 4d", "modo", "rhino", "keyshot", "thearender"]
TEXTURE_SIZES = [512, 1024, 2048, 4096, 8192, 16384]
RENDER, TEXTURE, PHOTO = "Render", "Doku", "Fotoğraf"
#: Names that cameras give, kinds of files.
DEVICE = r"(?i)^(?:img[_-]?\d{3,}|dsc[fn_]?\d{3,}|pxl_\d+|dji_\d+|gopr?\d+|\d{4}-?\d{2}-?\d{2}[t_ -]?\d{2}|\d{13,})"
CATEGORIES = {"cad": ["dwg", "dxf", "rvt", "rfa", "skp", "max", "ifc"], "image": ["jpg", "jpeg", "png", "bmp", "tif", "tiff", "gif", "webp", "psd"], "document": ["pdf", "doc", "docx", "txt", "rtf", "odt"], "sheet": ["xls", "xlsx", "csv", "ods"], "video": ["mp4", "mov", "avi", "mkv", "webm"]}
NOTHING = ["BOŞ", "YOK", "BOS", "-"]


def image_kind(name: Column, folder: Column, camera: Column | None = None, rendered: Column | None = None, width: Column | None = None, height: Column | None = None, software: Column | None = None, siblings: Column | None = None) -> Column:
    """Render, texture or photograph, by name, folders and files beside it, then by what the file says; null if none tells.

    camera: whether it has any camera data, a place included; software: the program that wrote it; siblings:
    extensions of the files of the same stem. A photograph told by its name stays one; else camera data make it
    one, a renderer's mark a render, sides of texture sizes a texture, and a large wide image a render.
    """
    low, places = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(folder, F.lit("")))
    stem = F.regexp_replace(low, r"(?<=.)\.[^.]*$", "")
    has = lambda c, words: c.rlike("|".join(map(re.escape, words)))
    no = F.lit(False)
    told = lambda c: F.coalesce(c, no) if c is not None else no
    texture_name = stem.rlike(f"(?:{'|'.join(map(re.escape, TEXTURE_ENDS))})$")
    textures, renders, photos = (has(places, words) for words in (TEXTURE_FOLDERS, RENDER_FOLDERS, PHOTO_FOLDERS))
    beside = told(F.arrays_overlap(F.transform(siblings, F.lower), F.array(*map(F.lit, RENDER_SIBLINGS))) if siblings is not None else None)
    by_name = (
        F.when(texture_name, TEXTURE).when(stem.rlike(DEVICE), PHOTO)
        .when(photos & ~textures, PHOTO).when(textures & ~renders & ~photos, TEXTURE)
        .when(has(low, PHOTO_WORDS), PHOTO).when(renders & ~textures & ~photos, RENDER)
        .when(has(low, TEXTURE_WORDS), TEXTURE).when(beside | has(low, RENDER_WORDS), RENDER)
        .when(low.rlike(f"(?<![A-Za-z0-9])(?:{'|'.join(map(re.escape, RENDER_WHOLE_WORDS))})(?![A-Za-z0-9])"), RENDER)
    )
    engine = told(has(F.lower(software), RENDER_ENGINES) if software is not None else None)
    square = wide = no
    if width is not None and height is not None:
        square = ((width == height) & (width >= 512) & (width.bitwiseAND(width - 1) == 0)) | (width.isin(TEXTURE_SIZES) & height.isin(TEXTURE_SIZES))
        wide = (width / height).between(1.3, 2.4) & ((width >= 2560) | (height >= 1440)) & F.coalesce(by_name == RENDER, F.lit(True))
    by_file = F.when(told(camera), PHOTO).when(told(rendered) | engine, RENDER).when(told(square), TEXTURE).when(told(wide), RENDER)
    return F.when(by_name == PHOTO, PHOTO).otherwise(F.coalesce(by_file, by_name))


def sibling_extensions(assets: DataFrame, name: str = "file_name", folder: str = "folder") -> DataFrame:
    """Assets with siblings: the other extensions, small, of the files in a folder that share a stem."""
    key = [F.lower(folder).alias("__f"), F.lower(F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")).alias("__s")]
    ext = F.lower(F.regexp_extract(name, r"(?<=.)\.([^.]*)$", 1))
    there = assets.select(*key, ext.alias("ext")).distinct().groupBy("__f", "__s").agg(F.array_sort(F.collect_set("ext")).alias("siblings"))
    return assets.select("*", *key, ext.alias("__e")).join(there, ["__f", "__s"], "left").withColumn("siblings", F.array_remove(F.coalesce("siblings", F.array().cast("array<string>")), F.col("__e"))).drop("__f", "__s", "__e")


#: Folders of kinds of files, and of states of approval.
EXT_FOLDERS = {
    "01-Cizimler": ["dwg", "dxf", "dwf", "dgn", "dwt"],
    "02-Gorseller": ["jpg", "jpeg", "png", "gif", "bmp", "tif", "tiff", "webp", "psd", "eps", "svg", "heic"],
    "03-Dokumanlar": ["pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "txt", "rtf", "odt", "ods", "csv"],
    "04-Modeller": ["skp", "3ds", "max", "obj", "fbx", "blend", "rvt", "ifc", "stl", "dae"],
    "05-Video": ["mp4", "mov", "avi", "mkv", "wmv", "flv", "webm"],
    "06-Ses": ["mp3", "wav", "flac", "aac", "ogg", "m4a"],
    "07-Arsivler": ["zip", "rar", "7z", "tar", "gz"],
}
APPROVAL_FOLDERS = {"Onayli": ["approved"], "Reddedilen": ["rejected"], "Bekleyen": ["draft", "review"]}
NO_KIND, NO_STATE, NO_DATE = "00-Diger", "00-Belirsiz", "00-Terminsiz"


def _folder(value: Column, folders: dict[str, list[str]], other: str) -> Column:
    out = F.lit(other)
    for name, values in folders.items():
        out = F.when(value.isin(values), name).otherwise(out)
    return out


def ext_folder(ext: Column) -> Column:
    return _folder(ascii_lower(ext), EXT_FOLDERS, NO_KIND)


def approval_folder(status: Column) -> Column:
    return _folder(status, APPROVAL_FOLDERS, NO_STATE)


def year_folder(deadline: Column) -> Column:
    """The year that a date in text begins with, if it has four digits."""
    year = F.regexp_extract(F.trim(deadline), r"^([0-9]{4})(?:[-/]|$)", 1)
    return F.coalesce(F.nullif(year, F.lit("")), F.lit(NO_DATE))


def file_category(ext: Column) -> Column:
    out = F.lit("other")
    for kind, names in CATEGORIES.items():
        out = F.when(ext.isin(names), kind).otherwise(out)
    return out


def mime_type(ext: Column) -> Column:
    """The media type of an extension, by the platform's table."""
    known = {k.lstrip("."): v for k, v in mimetypes.types_map.items()}
    table = F.create_map(*(F.lit(x) for pair in sorted(known.items()) for x in pair))
    return F.coalesce(F.try_element_at(table, ext), F.lit("application/octet-stream"))


def organise_path(levels: list[Column]) -> Column:
    """Folders of a plan, skipping empty ones."""
    return F.array_join(F.filter(F.array(*levels), lambda x: x.isNotNull() & (x != "")), "/")


def labelled_section(c: Column, label: str, labels: list[str]) -> Column:
    """What a labelled text has after one label, up to the next one."""
    stop = "|".join(re.escape(x) for x in labels)
    return F.trim(F.regexp_extract(c, rf"(?is)(?:^|\n)\s*{re.escape(label)}\s*:\s*(.*?)(?=\n\s*(?:{stop})\s*:|\z)", 1))


def listed(c: Column, vocabulary: list[str] | None = None) -> Column:
    """Distinct entries of a list in text, without blanks and words for nothing; only known ones if given."""
    parts = F.transform(F.split(c, r"[,;\n]"), lambda p: F.trim(p))
    parts = F.array_distinct(F.filter(parts, lambda p: (p != "") & ~F.upper(p).isin(NOTHING)))
    return parts if vocabulary is None else F.array_intersect(parts, F.array(*(F.lit(v) for v in vocabulary)))


def rerank_order(c: Column, n: int) -> Column:
    """Numbers 1 to n in the order a text names them, then the others."""
    named = F.transform(F.regexp_extract_all(c, F.lit(r"(\d{1,4})"), 1), lambda x: x.cast("int"))
    return F.array_distinct(F.concat(F.filter(named, lambda x: x.between(1, n)), F.sequence(F.lit(1), F.lit(n))))


def mentions(c: Column, tokens: list[str]) -> Column:
    return F.arrays_overlap(words(normalize_tr(c)), F.array(*(F.lit(t) for t in tokens)))


def translate_words(c: Column, dictionary: dict[str, str]) -> Column:
    """Whole words replaced, longer entries first."""
    for word in sorted(dictionary, key=lambda w: (-len(w), w)):
        c = F.regexp_replace(c, rf"(?iu)(?<![\p{{L}}\p{{N}}]){re.escape(word)}(?![\p{{L}}\p{{N}}])", dictionary[word])
    return c


def session_title(c: Column, n: int = 5, width: int = 60) -> Column:
    """The first significant words of a question, capitalised."""
    from ..functions.text import STOP_WORDS

    stop = F.array(*(F.lit(w) for w in STOP_WORDS))
    kept = F.slice(F.filter(F.split(F.trim(c), r"\s+"), lambda w: (F.char_length(w) >= 3) & ~F.array_contains(stop, F.lower(w))), 1, n)
    title = F.initcap(F.array_join(kept, " "))
    return F.when(F.char_length(title) > width, F.concat(F.substring(title, 1, width), F.lit("…"))).otherwise(title)
