"""Operators for preparing training data from crawled text; nothing else imports them."""
