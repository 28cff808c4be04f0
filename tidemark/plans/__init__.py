"""How jobs are set up and split: sessions, size checks, hot keys, ordered scans."""
