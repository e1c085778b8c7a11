"""Entry point for spark-submit; see footfall/__main__.py."""

from footfall.__main__ import main

if __name__ == "__main__":
    main()
