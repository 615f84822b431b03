"""What a file declares about where it came from."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Strings that files carry, each with what it declares; the first in this order that occurs counts.
AI_MARKERS = (
    ("rainedalgorithmicmedia", "marked AI-generated in its metadata (IPTC digital source type)"),
    ("midjourney", "Midjourney"),
    ("stable diffusion", "Stable Diffusion"),
    ("stablediffusion", "Stable Diffusion"),
    ("dall-e", "DALL-E"),
    ("dallÂ·e", "DALL-E"),
    ("adobe firefly", "Adobe Firefly"),
    ("novelai", "NovelAI"),
    ("comfyui", "ComfyUI"),
    ("invokeai", "InvokeAI"),
)
SETTINGS = r"steps: [0-9]+, sampler: "
GRAPH = ('"class_type"', '"inputs"')
STOCK_MARKERS = (
    ("getty images", "Getty Images"),
    ("gettyimages", "Getty Images"),
    ("shutterstock", "Shutterstock"),
    ("istockphoto", "iStock"),
    ("istock by getty", "iStock"),
    ("adobe stock", "Adobe Stock"),
    ("stock.adobe.com", "Adobe Stock"),
    ("alamy", "Alamy"),
    ("depositphotos", "Depositphotos"),
    ("dreamstime", "Dreamstime"),
    ("123rf", "123RF"),
    ("pond5", "Pond5"),
    ("stocksy", "Stocksy"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-cases ASCII letters alone: bytes of other characters must stay as they are."""
    return F.translate(text, _UPPER, _LOWER)


def first_marker(text: Column, markers: tuple[tuple[str, str], ...]) -> Column:
    return F.coalesce(*[F.when(F.contains(text, F.lit(needle)), F.lit(label)) for needle, label in markers])


def ai_marker(text: Column) -> Column:
    """Of text whose characters are the file's bytes, lower-cased."""
    flat = F.translate(text, "\x00", "")
    settings = F.when(flat.rlike(SETTINGS), F.lit("Stable Diffusion settings (Steps, Sampler)"))
    graph = F.when(F.contains(text, F.lit(GRAPH[0])) & F.contains(text, F.lit(GRAPH[1])), F.lit("ComfyUI workflow"))
    return F.coalesce(first_marker(text, AI_MARKERS), settings, graph)


def stock_marker(text: Column) -> Column:
    return first_marker(text, STOCK_MARKERS)


def bytes_as_text(content: Column, limit: int) -> Column:
    """A character for each of the first ``limit`` bytes, ASCII letters lower-cased."""
    return ascii_lower(F.decode(F.substring(content, 1, limit), "ISO-8859-1"))
