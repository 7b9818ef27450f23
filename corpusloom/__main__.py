import sys

from corpusloom.cli import main

sys.exit(main())
