"""Structured Streaming operators. Every stateful operator carries an explicit watermark."""
